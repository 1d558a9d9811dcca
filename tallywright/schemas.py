"""Fixed schemas of the ledger's tables, as DDL. Ids are lower-case UUID strings or other text; hashes are lower-case hex."""

from __future__ import annotations

SCHEMAS = {
    "decisions": "tenant_id string, id string, title string, statement string, status string, scope struct<domain:string,system:string,team:string,env:string>, scope_domain string, scope_system string, owner string, confidence double, fingerprint string, parent_id string, evidence_ids array<string>, temporal_metadata struct<effective_from:timestamp,effective_to:timestamp,ttl_seconds:bigint>, created_at timestamp, updated_at timestamp, approved_at timestamp, valid_from timestamp, valid_to timestamp, merkle_hash string, parent_merkle_hash string",
    "decision_revisions": "tenant_id string, id string, decision_id string, revision_number int, snapshot_json string, created_at timestamp",
    "contradictions": "id string, tenant_id string, decision_a string, decision_b string, severity string, quarantined boolean, resolved boolean, resolution_strategy string, created_at timestamp, resolved_at timestamp, auto_resolved_at timestamp",
    "edges": "tenant_id string, from_id string, to_id string, edge_type string, created_at timestamp",
    "chain": "tenant_id string, id string, height bigint, leaf_hash string, parent_root string, root_hash string",
    "snapshots": "id string, tenant_id string, root_hash string, block_height bigint, parent_snapshot_id string, snapshot_hash string, epoch_timestamp timestamp, epoch_unix bigint, created_at timestamp",
    "evidence": "tenant_id string, block_hash string, content string, ref_count int, created_at timestamp",
    "evidence_blocks": "id string, tenant_id string, decision_id string, prev_hash string, evidence_hash string, payload string, created_at timestamp",
    "ref_changes": "hash string, delta string, ts timestamp",
    "tenant_budgets": "tenant_id string, token_balance bigint, tokens_consumed bigint, execution_limit int, executions_consumed int, status string, monthly_limit bigint, last_reset_at timestamp, created_at timestamp, updated_at timestamp",
    "budget_requests": "tenant_id string, request_id bigint, ts timestamp, agent_id string, task_id string, tokens_used int, executions_used int, operation string",
    "budget_ledger": "id string, tenant_id string, agent_id string, task_id string, tokens_used int, executions_used int, operation string, created_at timestamp",
    "checkpoints": "id string, tenant_id string, agent_id string, task_id string, checkpoint_data string, status string, created_at timestamp, updated_at timestamp, expires_at timestamp",
    "messages": "channel_id string, ts string, text string",
    "harvested": "id string, source_type string, source_id string, source_url string, raw_text string, extracted_decision string, confidence double, human_validated boolean, decision_id string, created_at timestamp, updated_at timestamp",
    "task_manifests": "task_id string, customer_id string, credential_ref string, title string, scope_domain string, scope_system string, status string, manifest_blocks array<string>, normalized_ir string, ir_version int, decision_ids array<string>, created_at timestamp, updated_at timestamp",
    "telemetry_events": "ts timestamp, tenant_id string, kind string, name string, reused boolean, latency_us bigint, tokens bigint, model string",
}

PROPOSAL = "tenant_id string, title string, statement string, domain string, system string, owner string, confidence double, parent_id string, valid_from string, valid_to string"
CHECKPOINT_REQUEST = "tenant_id string, agent_id string, task_id string, checkpoint_data string, ttl_seconds bigint"
BUDGET_REQUEST = "tenant_id string, agent_id string, task_id string, tokens_used int, executions_used int, operation string"
CHECKPOINT_DATA = "execution_version int, progress_percent int, active_goal string, reasoning_chain array<string>, files_touched array<string>, discovered_facts array<struct<id:string,claim:string,source:string,confidence:double,observed_at:timestamp>>, decision_ids array<string>, pending_steps array<string>, state_snapshot map<string,string>"
