"""Every ledger operator as a query over the given tables, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import fresh_path, written
from ..functions import scalars as X
from ..operators import budget, chain, checkpoints, contradiction, evidence, filters, graph, harvest, quality, telemetry, temporal
from ..sources import tables
from .adapters import LEAFED, adapted, cte, leafed, sql_text, table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AT = "1998-01-01 00:00:00"
RULE = contradiction.Rule("red", "blue", ("ECONOMY", "PROMO"))
KEYWORDS = ["the", "que", "und", "and"]
BALANCE = 3000


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _at() -> F.Column:
    return F.lit(AT).cast("timestamp_ntz")


# --- Filters and lookups -------------------------------------------------------------------------------------------

_BRIEF = ["tenant_id", "id", "title", "status", "scope_domain", "scope_system"]
_BRIEF_SQL = "tenant_id, id, title, status, scope_domain, scope_system"


@query(f"{cte('decisions')} SELECT {_BRIEF_SQL} FROM decisions WHERE tenant_id = '3'")
def f01_for_tenant(spark, d):
    return filters.for_tenant(adapted(spark, d, "decisions"), "3").select(*_BRIEF)


@query(f"{cte('decisions')} SELECT {_BRIEF_SQL} FROM decisions WHERE tenant_id = '3' AND scope_domain = '1-URGENT' AND scope_system = 'db'")
def f02_by_scope(spark, d):
    return filters.by_scope(filters.for_tenant(adapted(spark, d, "decisions"), "3"), "1-URGENT", "db").select(*_BRIEF)


@query(f"{cte('decisions')} SELECT {_BRIEF_SQL} FROM decisions WHERE scope_domain = '2-HIGH' AND status IN ('canonical', 'approved')")
def f03_list_decisions(spark, d):
    rows = adapted(spark, d, "decisions").withColumn("scope", F.struct(F.col("scope_domain").alias("domain"), F.col("scope_system").alias("system")))
    return filters.list_decisions(rows, None, {"domain": "2-HIGH", "system": ""}, ["canonical", "approved"]).select(*_BRIEF)


@query(f"{cte('decisions')} SELECT {_BRIEF_SQL} FROM decisions WHERE tenant_id = (SELECT tenant_id FROM decisions WHERE id = 7) AND id = 7")
def f04_get(spark, d):
    rows = adapted(spark, d, "decisions")
    return rows.join(filters.tenants(rows.filter("id = 7")), "tenant_id", "left_semi").filter("id = 7").select(*_BRIEF)


@query(f"{cte('nodes')} SELECT tenant_id, id, title FROM nodes WHERE tenant_id = 'all' AND parent_id = 12")
def f05_children_of(spark, d):
    return filters.children_of(adapted(spark, d, "nodes"), "all", 12).select("tenant_id", "id", "title")


@query(f"{cte('decisions')} SELECT id, title, confidence, count(*) OVER () AS n_found FROM decisions WHERE tenant_id = '4' AND contains(lower(title), lower('URGENT 1'))")
def f06_search_titles(spark, d):
    return filters.search_titles(adapted(spark, d, "decisions"), "4", "URGENT 1").select("id", "title", "confidence", "n_found")


@query(f"{cte('decisions')}, r AS (SELECT tenant_id, customer AS decision_id, row_number() OVER (PARTITION BY customer ORDER BY created_at, id) AS revision_number, id FROM decisions) SELECT decision_id, CAST(revision_number AS INTEGER) AS revision_number, id FROM r WHERE tenant_id = '3' AND decision_id = 13")
def f07_revisions(spark, d):
    from pyspark.sql import Window

    rows = adapted(spark, d, "decisions").select("tenant_id", F.col("customer").alias("decision_id"), F.row_number().over(Window.partitionBy("customer").orderBy("created_at", "id")).alias("revision_number"), "id")
    return filters.revisions(rows, "3", 13).select("decision_id", "revision_number", "id")


@query(f"{cte('checkpoints')} SELECT id, agent_id, task_id FROM checkpoints WHERE tenant_id = '1' AND agent_id = '5' AND status = 'active' ORDER BY created_at DESC, id LIMIT 5")
def f08_agent_checkpoints(spark, d):
    return filters.agent_checkpoints(adapted(spark, d, "checkpoints"), "1", "5", 5).select("id", "agent_id", "task_id")


_HARVEST_SQL = (
    cte("messages")
    + r""", m AS (SELECT *, regexp_extract_all(text, '(?i)(the|que|und|and)\s*([^.!?]+[.!?])', 2) AS found FROM messages WHERE coalesce(text, '') <> ''),
h AS (SELECT channel_id, ts, concat(channel_id, ':', ts) AS source_id, concat('https://chat.example.com/archives/', channel_id, '/p', regexp_replace(ts, '^([^.]*)\.', '\1')) AS source_url, text,
       len(found) AS n_matches, CASE WHEN len(found) > 0 THEN trim(found[1]) ELSE '' END AS extracted_decision, CASE WHEN len(found) = 0 THEN CAST(0 AS DOUBLE) ELSE least(CAST(0.95 AS DOUBLE), CAST(0.7 AS DOUBLE) + len(found) * CAST(0.05 AS DOUBLE)) END AS confidence FROM m)
"""
)


@query(_HARVEST_SQL + "SELECT source_id, extracted_decision, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM h WHERE confidence >= 0.7")
def f09_list_harvested(spark, d):
    rows = harvest.harvest(adapted(spark, d, "messages"), KEYWORDS).withColumn("created_at", F.col("source_id"))
    return filters.list_harvested(rows, "chat").select("source_id", "extracted_decision", F.round("confidence", 6).alias("confidence"))


# The closed form of sequential quarantine, also the base of several queries below.
_QUARANTINE_SQL = f"""{cte('proposals')}, c AS (
    SELECT *, CASE WHEN scope_system NOT IN ('ECONOMY', 'PROMO') THEN 'none' WHEN contains(lower(title), 'red') AND contains(lower(title), 'blue') THEN 'AB' WHEN contains(lower(title), 'red') THEN 'A' WHEN contains(lower(title), 'blue') THEN 'B' ELSE 'none' END AS cls FROM proposals
), w AS (
    SELECT *, row_number() OVER (PARTITION BY tenant_id, scope_domain, scope_system, title ORDER BY id) AS t, first_value(id) OVER (PARTITION BY tenant_id, scope_domain, scope_system, title ORDER BY id) AS ft,
           min(CASE WHEN cls <> 'none' THEN id END) OVER (PARTITION BY tenant_id, scope_domain, scope_system) AS fid FROM c
), x AS (
    SELECT w.*, l.cls AS fc FROM w LEFT JOIN c l ON l.id = w.fid
), q AS (
    SELECT *, CASE WHEN cls <> 'none' AND id <> fid AND NOT (cls = fc AND cls <> 'AB') THEN 'keyword' WHEN t > 1 THEN 'title' END AS conflict_kind FROM x
), quarantined AS (
    SELECT tenant_id, id, title, scope_domain, scope_system, CASE WHEN conflict_kind IS NULL THEN status ELSE 'quarantined' END AS status, conflict_kind, CASE conflict_kind WHEN 'keyword' THEN fid WHEN 'title' THEN ft END AS conflicting_id FROM q
)"""


def _quarantined(spark, d):
    return contradiction.quarantine(adapted(spark, d, "proposals"), None, RULE)


@query(_QUARANTINE_SQL + " SELECT tenant_id, id, status, conflicting_id, conflict_kind FROM quarantined")
def c05_quarantine(spark, d):
    return _quarantined(spark, d).select("tenant_id", "id", "status", "conflicting_id", "conflict_kind")


@query(_QUARANTINE_SQL + " SELECT tenant_id, id, status, conflicting_id FROM quarantined")
def c05_quarantine_fold(spark, d):
    return contradiction.quarantine_fold(adapted(spark, d, "proposals"), (RULE,)).select("tenant_id", "id", "status", "conflicting_id")


#: A second rule beside the first.
OTHER_RULE = contradiction.Rule("green", "white", ("STANDARD", "SMALL", "PROMO"))


def _opposed(rule: contradiction.Rule, new: str, old: str) -> str:
    one, other = (f"contains(lower({{0}}.title), '{w}')" for w in (rule.one, rule.other))
    return f"({new}.scope_system IN {rule.systems} AND (({one.format(new)} AND {other.format(old)}) OR ({other.format(new)} AND {one.format(old)})))"


@query(f"""{cte('wild')}, n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY id) AS rn FROM wild)
SELECT tenant_id, id, CASE WHEN hit IS NULL THEN 'draft' ELSE 'quarantined' END AS status, hit AS conflicting_id FROM (WITH RECURSIVE r AS (
    SELECT tenant_id, rn, id, CAST(NULL AS BIGINT) AS hit, [struct_pack(id := id, title := title, d := scope_domain, s := scope_system)] AS kept FROM n WHERE rn = 1
    UNION ALL SELECT tenant_id, rn, id, hit, CASE WHEN hit IS NULL THEN list_append(kept, struct_pack(id := id, title := title, d := scope_domain, s := scope_system)) ELSE kept END
    FROM (SELECT n.*, r.kept, (list_filter(r.kept, lambda k: (n.scope_domain = '' OR n.scope_domain = k.d) AND (n.scope_system = '' OR n.scope_system = k.s) AND (n.title = k.title OR {_opposed(RULE, 'n', 'k')} OR {_opposed(OTHER_RULE, 'n', 'k')}))[1]).id AS hit FROM r JOIN n ON n.tenant_id = r.tenant_id AND n.rn = r.rn + 1)
) SELECT * FROM r)""")
def c05_quarantine_rules(spark, d):
    """Two rules, and empty scope parts that mean any: settled in parallel rounds, as if one after another."""
    return contradiction.quarantine(adapted(spark, d, "wild"), None, (RULE, OTHER_RULE)).select("tenant_id", "id", "status", "conflicting_id")


_SPLIT_SQL = f"""{cte('proposals')}, pairs AS (
    SELECT n.tenant_id, n.id, o.id AS conflicting_id FROM proposals n JOIN proposals o ON n.tenant_id = o.tenant_id AND n.scope_domain = o.scope_domain AND n.scope_system = o.scope_system AND n.id % 2 = 1 AND o.id % 2 = 0
    WHERE n.title = o.title OR (n.scope_system IN ('ECONOMY', 'PROMO') AND ((contains(lower(n.title), 'red') AND contains(lower(o.title), 'blue')) OR (contains(lower(n.title), 'blue') AND contains(lower(o.title), 'red')))))"""


def _pairs(spark, d):
    rows = adapted(spark, d, "proposals")
    return contradiction.conflict_pairs(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"), (RULE,))


@query(_SPLIT_SQL + " SELECT tenant_id, id, conflicting_id FROM pairs")
def c03_conflict_pairs(spark, d):
    return _pairs(spark, d).select("tenant_id", "id", "conflicting_id")


@query(_SPLIT_SQL + " SELECT tenant_id, id, min(conflicting_id) AS conflicting_id FROM pairs GROUP BY ALL")
def c04_first_conflict(spark, d):
    rows = adapted(spark, d, "proposals")
    return contradiction.earliest_conflicts(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"), (RULE,))


@query(f"""{cte('wild')} SELECT n.tenant_id, n.id, arg_min(o.id, struct_pack(a := o.created_at, b := o.id)) AS conflicting_id FROM wild n JOIN wild o ON n.tenant_id = o.tenant_id AND (n.scope_domain = '' OR n.scope_domain = o.scope_domain) AND (n.scope_system = '' OR n.scope_system = o.scope_system) AND n.id <> o.id
    WHERE n.title = o.title OR (n.scope_system IN ('ECONOMY', 'PROMO') AND ((contains(lower(n.title), 'red') AND contains(lower(o.title), 'blue')) OR (contains(lower(n.title), 'blue') AND contains(lower(o.title), 'red')))) GROUP BY ALL""")
def c04_first_conflict_wildcards(spark, d):
    """Each proposal's earliest conflict among all of them, itself left out; empty scope parts mean any."""
    rows = adapted(spark, d, "wild")
    return contradiction.earliest_conflicts(rows, rows, (RULE,))


@query(f"""{cte('proposals')}, p AS (SELECT a.id AS id, b.id AS next_id, a.title AS ta, b.title AS tb, b.scope_system AS s FROM proposals a JOIN proposals b ON b.id = a.id + 1)
SELECT id, next_id, ta = tb OR (s IN ('ECONOMY', 'PROMO') AND ((contains(lower(tb), 'red') AND contains(lower(ta), 'blue')) OR (contains(lower(tb), 'blue') AND contains(lower(ta), 'red')))) AS contradictory,
       CASE WHEN contains(lower(ta), 'red') AND contains(lower(ta), 'blue') THEN 'AB' WHEN contains(lower(ta), 'red') THEN 'A' WHEN contains(lower(ta), 'blue') THEN 'B' ELSE 'none' END AS cls FROM p""")
def c01_c02_pair_predicate(spark, d):
    a = adapted(spark, d, "proposals")
    b = a.select((F.col("id") - 1).alias("id"), F.col("id").alias("next_id"), F.col("title").alias("tb"), F.col("scope_system").alias("s"))
    return a.join(b, "id").select("id", "next_id", contradiction.is_contradictory(F.col("tb"), F.col("s"), F.col("title"), (RULE,)).alias("contradictory"), contradiction.title_class(F.col("title"), RULE).alias("cls"))


_UUID_SQL = "(SELECT concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) FROM (SELECT sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode({0})) AS h))"


@query(_QUARANTINE_SQL + f" SELECT {_UUID_SQL.format('key')} AS id, tenant_id, decision_a, decision_b, 'medium' AS severity, true AS quarantined, false AS resolved, 'human' AS resolution_strategy FROM (SELECT *, concat(CAST(conflicting_id AS VARCHAR), '|', CAST(id AS VARCHAR)) AS key, CAST(conflicting_id AS VARCHAR) AS decision_a, CAST(id AS VARCHAR) AS decision_b FROM quarantined WHERE conflicting_id IS NOT NULL) z")
def c06_contradiction_records(spark, d):
    return contradiction.contradiction_records(_quarantined(spark, d), _at()).drop("created_at", "resolved_at", "auto_resolved_at")


@query(_QUARANTINE_SQL + " SELECT q.id, concat('Proposed decision ''', q.title, ''' contradicts active decision ''', o.title, ''' (ID: ', CAST(o.id AS VARCHAR), ') in scope ', q.scope_domain, '/', q.scope_system) AS reason FROM quarantined q JOIN proposals o ON o.id = q.conflicting_id")
def c07_reason(spark, d):
    titles = adapted(spark, d, "proposals").select("tenant_id", F.col("id").alias("conflicting_id"), F.col("title").alias("conflicting_title"))
    return contradiction.reason(_quarantined(spark, d), titles).select("id", "reason")


@query(_QUARANTINE_SQL + " SELECT CAST(conflicting_id AS VARCHAR) AS decision_a, CAST(id AS VARCHAR) AS decision_b, id % 2 = 0 AS resolved, CASE WHEN id % 4 = 0 THEN 'auto_supersede' ELSE 'human' END AS resolution_strategy, id % 2 = 0 AS has_time, id % 4 = 0 AS has_auto FROM quarantined WHERE conflicting_id IS NOT NULL")
def c08_resolve(spark, d):
    records = contradiction.contradiction_records(_quarantined(spark, d), _at().cast("timestamp"))
    n = F.col("decision_b").cast("long")
    chosen = records.filter(n % 2 == 0).select("tenant_id", "id", F.when(n % 4 == 0, "auto_supersede").otherwise("human").alias("strategy"))
    out = contradiction.resolve(records, chosen, _at().cast("timestamp"))
    return out.select("decision_a", "decision_b", "resolved", "resolution_strategy", F.col("resolved_at").isNotNull().alias("has_time"), F.col("auto_resolved_at").isNotNull().alias("has_auto"))


@query(_QUARANTINE_SQL + " SELECT tenant_id, CAST(conflicting_id AS VARCHAR) AS decision_a, CAST(id AS VARCHAR) AS decision_b FROM quarantined WHERE conflicting_id IS NOT NULL AND tenant_id = '1' AND id % 2 <> 0")
def f10_f11_contradiction_lists(spark, d):
    records = contradiction.contradiction_records(_quarantined(spark, d), _at().cast("timestamp")).withColumn("resolved", F.col("decision_b").cast("long") % 2 == 0)
    both = filters.list_contradictions(records, "1", False).join(filters.unresolved(records, "1").select("tenant_id", "id"), ["tenant_id", "id"])
    return both.select("tenant_id", "decision_a", "decision_b")


@query(f"{cte('proposals')} SELECT tenant_id, id, CASE WHEN id % 5 = 0 THEN 'quarantined' ELSE status END AS status FROM proposals")
def j09_apply_status(spark, d):
    rows = adapted(spark, d, "proposals")
    return contradiction.apply_status(rows, rows.filter("id % 5 = 0"), "quarantined").select("tenant_id", "id", "status")


@query(f"{cte('writes')} SELECT DISTINCT tenant_id FROM writes")
def f12_tenants(spark, d):
    return filters.tenants(adapted(spark, d, "writes"))


@query(f"{cte('decisions')} SELECT id, CASE WHEN id % 4 = 0 THEN 'draft' ELSE status END AS status, CASE WHEN owner = '' THEN 'agent-system' ELSE owner END AS owner, CASE WHEN id % 3 = 0 THEN scope_system ELSE scope_domain END AS scope_domain, {sql_text('valid_from')} AS valid_from, '' AS merkle_hash FROM decisions")
def f13_f14_normalize(spark, d):
    rows = adapted(spark, d, "decisions").withColumns({"status": F.when(F.col("id") % 4 == 0, F.lit("nonsense")).otherwise(F.concat(F.lit(" "), F.upper("status"))), "scope": F.struct(F.when(F.col("id") % 3 == 0, F.col("scope_system")).alias("domain"), F.lit(None).cast("string").alias("system"), F.lit(None).cast("string").alias("team"), F.lit(None).cast("string").alias("env")), "merkle_hash": F.lit(None).cast("string")})
    rows = rows.withColumn("scope_domain", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("scope_domain")))
    out = filters.blank_hashes(filters.normalize_decisions(rows, _at()), ["merkle_hash"])
    return text_of(out.select("id", "status", "owner", "scope_domain", "valid_from", "merkle_hash"), "valid_from")


@query(_HARVEST_SQL + "SELECT source_id FROM h WHERE confidence >= 0.9")
def f15_promotable(spark, d):
    return filters.promotable(harvest.harvest(adapted(spark, d, "messages"), KEYWORDS), 0.9).select("source_id")


_BUDGETS_SQL = cte("requests") + f", budgets AS (SELECT DISTINCT tenant_id, CAST({BALANCE} AS BIGINT) AS token_balance, CASE WHEN CAST(tenant_id AS BIGINT) % 10 = 0 THEN 'exhausted' ELSE 'active' END AS status FROM requests WHERE CAST(tenant_id AS BIGINT) % 3 <> 0)"


def _budgets(spark, d):
    ids = adapted(spark, d, "requests").select("tenant_id").distinct().filter("CAST(tenant_id AS BIGINT) % 3 <> 0")
    status = F.when(F.col("tenant_id").cast("long") % 10 == 0, "exhausted").otherwise("active")
    return ids.select("tenant_id", F.lit(BALANCE).cast("long").alias("token_balance"), F.lit(0).cast("long").alias("tokens_consumed"), F.lit(50).alias("execution_limit"), F.lit(0).alias("executions_consumed"), status.alias("status"))


@query(_BUDGETS_SQL + " SELECT request_id, coalesce(b.status <> 'exhausted' AND b.token_balance >= tokens_used * 40, false) AS admitted, CASE WHEN b.tenant_id IS NULL THEN 'no budget' WHEN b.status = 'exhausted' THEN 'exhausted' WHEN b.token_balance < tokens_used * 40 THEN concat('need ', CAST(tokens_used * 40 AS VARCHAR), ', have ', CAST(b.token_balance AS VARCHAR)) END AS reason FROM requests LEFT JOIN budgets b USING (tenant_id)")
def f16_preflight(spark, d):
    rows = adapted(spark, d, "requests").withColumn("estimate", F.col("tokens_used") * 40)
    return filters.preflight(rows, _budgets(spark, d)).select("request_id", "admitted", "reason")


@query(_BUDGETS_SQL + " SELECT t.tenant_id, coalesce(b.token_balance, 1000000) AS token_balance, CASE WHEN b.tenant_id IS NULL THEN 10000 ELSE 50 END AS execution_limit, coalesce(b.status, 'active') AS status FROM (SELECT DISTINCT tenant_id FROM requests) t LEFT JOIN budgets b USING (tenant_id)")
def f17_budgets_with_defaults(spark, d):
    return filters.budgets_with_defaults(adapted(spark, d, "requests"), _budgets(spark, d)).select("tenant_id", "token_balance", "execution_limit", "status")


# --- Sources and sinks ---------------------------------------------------------------------------------------------


@query(f"{cte('messages')} SELECT channel_id, ts, text FROM messages WHERE ts >= '2' AND channel_id IN ('1', '2', '3', '10')")
def s02_messages_since(spark, d):
    return tables.messages_since(adapted(spark, d, "messages"), "2", ["1", "2", "3", "10"]).select("channel_id", "ts", "text")


@query(f"""{cte('decisions')} SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE CASE WHEN id % 10 = 1 THEN '' ELSE title END END AS title, CASE WHEN id % 10 = 0 THEN 'malformed_json' WHEN id % 10 = 1 THEN 'missing_title' WHEN id % 10 = 2 THEN 'missing_tenant' END AS reject_reason FROM decisions""")
def s04_parse_proposals(spark, d):
    rows = adapted(spark, d, "decisions")
    n = F.col("id") % 10
    body = F.to_json(F.struct(F.when(n != 2, F.col("tenant_id")).alias("tenant_id"), F.when(n == 1, "").otherwise(F.col("title")).alias("title"), F.col("scope_domain").alias("domain")))
    return tables.parse_proposals(rows.select("id", F.when(n == 0, "{broken").otherwise(body).alias("body")), "body").select("id", "title", "reject_reason")


@query(f"{cte('requests')} SELECT request_id, CASE WHEN request_id % 6 = 0 THEN 'missing_agent' WHEN request_id % 6 = 1 THEN 'negative_amount' END AS reject_reason FROM requests")
def s05_parse_budget_requests(spark, d):
    n = F.col("request_id") % 6
    body = F.to_json(F.struct(F.when(n == 0, "").otherwise(F.col("agent_id")).alias("agent_id"), F.when(n == 1, -1).otherwise(F.col("tokens_used").cast("int")).alias("tokens_used")))
    return tables.parse_budget_requests(adapted(spark, d, "requests").select("request_id", body.alias("body")), "body").select("request_id", "reject_reason")


@query(f"{cte('messages')} SELECT channel_id, ts, text FROM messages WHERE ts >= '2' AND channel_id IN ('1', '2', '3', '10')")
def s02_read_messages(spark, d):
    """A message export as JSON lines, scanned with its fixed schema."""
    path = fresh_path(spark, "export")
    adapted(spark, d, "messages").select("channel_id", "ts", "text").write.json(path)
    return tables.read_messages(spark, path, "2", ["1", "2", "3", "10"])


@query(f"""{cte('requests')} SELECT request_id, CASE WHEN request_id % 6 IN (0, 2) THEN NULL ELSE agent_id END AS agent, CASE WHEN request_id % 6 = 0 THEN NULL ELSE request_id % 100 END AS ttl_seconds, CASE request_id % 6 WHEN 0 THEN 'malformed_json' WHEN 2 THEN 'missing_agent' END AS reject_reason FROM requests""")
def s05_parse_checkpoints(spark, d):
    n = F.col("request_id") % 6
    body = F.to_json(F.struct("tenant_id", F.when(n != 2, F.col("agent_id")).alias("agent_id"), F.col("operation").alias("task_id"), F.lit("{}").alias("checkpoint_data"), (F.col("request_id") % 100).alias("ttl_seconds")))
    rows = adapted(spark, d, "requests").select("request_id", F.when(n == 0, "{\"agent_id\": ").otherwise(body).alias("body"))
    return tables.parse_checkpoints(rows, "body").select("request_id", F.col("agent_id").alias("agent"), "ttl_seconds", "reject_reason")


@query(f"""{cte('decisions')}, u AS (SELECT tenant_id, customer AS id, title, created_at, row_number() OVER (PARTITION BY tenant_id, customer ORDER BY created_at DESC, id DESC) AS rn, min(created_at) OVER (PARTITION BY tenant_id, customer) AS first_at FROM decisions)
SELECT tenant_id, id, title, {sql_text('first_at')} AS created_at FROM u WHERE rn = 1""")
def s06_upsert(spark, d):
    rows = adapted(spark, d, "decisions").select("tenant_id", F.col("customer").alias("id"), "title", "created_at", F.struct("created_at", F.col("id")).alias("version"))
    old = rows.filter(F.col("created_at") < _at())
    return text_of(tables.upsert(old, rows.filter(F.col("created_at") >= _at()), ["tenant_id", "id"], ["version"]).drop("version"), "created_at")


@query(f"""{cte('decisions')}, a AS (SELECT customer, min(id) AS id FROM decisions WHERE created_at < TIMESTAMP '{AT}' GROUP BY customer), b AS (SELECT customer, min(id) AS id FROM decisions WHERE created_at >= TIMESTAMP '{AT}' GROUP BY customer)
SELECT customer, id FROM a UNION ALL SELECT customer, id FROM b WHERE customer NOT IN (SELECT customer FROM a)""")
def s07_insert_ignore(spark, d):
    rows = adapted(spark, d, "decisions")
    old = rows.filter(F.col("created_at") < _at()).groupBy("customer").agg(F.min("id").alias("id"))
    return tables.insert_ignore(old, rows.filter(F.col("created_at") >= _at()).select("customer", "id"), ["customer"], ["id"])


@query(f"{cte('requests')} SELECT request_id, tenant_id, tokens_used FROM requests")
def s01_s08_append_and_scan(spark, d):
    from ..common import fresh_path, written

    path = fresh_path(spark, "budget_ledger")
    rows = adapted(spark, d, "requests").select(F.col("request_id").cast("string").alias("id"), "tenant_id", "agent_id", F.lit("t").alias("task_id"), F.col("tokens_used").cast("int").alias("tokens_used"), F.lit(1).alias("executions_used"), "operation", F.col("ts").cast("timestamp").alias("created_at"))
    for half in (0, 1):
        tables.append(rows.filter(F.col("id").cast("long") % 2 == half), path)
    return tables.read_table(spark, "budget_ledger", path).select(F.col("id").cast("long").alias("request_id"), "tenant_id", F.col("tokens_used").cast("long").alias("tokens_used"))


@query("""SELECT concat('{"n_nationkey":', CAST(n_nationkey AS VARCHAR), ',"n_regionkey":', CAST(n_regionkey AS VARCHAR), '}') AS json FROM nation""")
def s09_json_rows(spark, d):
    return tables.to_json_rows(table(spark, d, "nation").select("n_nationkey", "n_regionkey"))


@query("""SELECT n_regionkey, count(*) AS count, concat('[', string_agg(concat('{"n_nationkey":', CAST(n_nationkey AS VARCHAR), '}'), ',' ORDER BY n_nationkey), ']') AS items FROM nation GROUP BY n_regionkey""")
def s09_envelope(spark, d):
    return tables.envelope(table(spark, d, "nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], ["n_nationkey"])


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS task_id, concat('v', CASE WHEN s_suppkey % 2 = 0 THEN '2' ELSE '1' END) AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'b,c' ELSE 'a' END AS blocks FROM supplier""")
def s10_save_manifests(spark, d):
    base = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("task_id"), F.lit("v1").alias("title"), F.array(F.lit("a")).alias("manifest_blocks"), F.lit(1).alias("updated_at"), F.lit(1).alias("created_at"))
    news = base.filter(F.col("task_id").cast("long") % 2 == 0).withColumns({"title": F.lit("v2"), "manifest_blocks": F.array(F.lit("b"), F.lit("c")), "updated_at": F.lit(2)})
    return tables.save_manifests(base, news).select("task_id", "title", F.array_join("manifest_blocks", ",").alias("blocks"))


# --- Chains --------------------------------------------------------------------------------------------------------

_CHAIN_SQL = f"""{cte('writes')}, {LEAFED}, chained AS (
    SELECT tenant_id, id, ts, leaf_hash, row_number() OVER w AS height, list(leaf_hash) OVER (w ROWS UNBOUNDED PRECEDING) AS leaves FROM leafed WINDOW w AS (PARTITION BY tenant_id ORDER BY ts, id)
), rooted AS (
    SELECT tenant_id, id, ts, leaf_hash, height, list_reduce(leaves, lambda a, x: sha256(concat(a, x)), '{X.GENESIS}') AS root_hash FROM chained
), chain AS (
    SELECT *, lag(root_hash, 1, '{X.GENESIS}') OVER (PARTITION BY tenant_id ORDER BY height) AS parent_root FROM rooted
)"""


def _chain(spark, d):
    return chain.chain(leafed(adapted(spark, d, "writes")), ["ts", "id"])


@query(_CHAIN_SQL + " SELECT tenant_id, id, height, parent_root, root_hash FROM chain")
def w02_chain(spark, d):
    return _chain(spark, d).select("tenant_id", "id", "height", "parent_root", "root_hash")


@query(_CHAIN_SQL + " SELECT tenant_id, arg_max(root_hash, height) AS root_hash, max(height) AS height FROM chain GROUP BY tenant_id")
def w01_chain_roots(spark, d):
    return chain.chain_roots(_chain(spark, d))


@query(_CHAIN_SQL + f" SELECT c.c_custkey AS customer, coalesce(r.root_hash, '{X.GENESIS}') AS root_hash, coalesce(r.height, 0) AS height FROM customer c LEFT JOIN (SELECT tenant_id, arg_max(root_hash, height) AS root_hash, max(height) AS height FROM chain GROUP BY tenant_id) r ON r.tenant_id = CAST(c.c_custkey AS VARCHAR)")
def w03_genesis(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("tenant_id"))
    roots = chain.genesis(customers, chain.chain_roots(_chain(spark, d)))
    return roots.join(customers, "tenant_id", "left_semi").select(F.col("tenant_id").cast("long").alias("customer"), "root_hash", "height")


@query(_CHAIN_SQL + " SELECT id, true AS is_verified, id % 100 <> 7 AS link_ok FROM chain")
def w04_verify_links(spark, d):
    spoiled = _chain(spark, d).withColumn("leaf_hash", F.when(F.col("id") % 100 == 7, F.sha2("leaf_hash", 256)).otherwise(F.col("leaf_hash")))
    return chain.verify_links(spoiled).select("id", "is_verified", "link_ok")


@query(_CHAIN_SQL + " SELECT tenant_id, count(*) AS writes, count(*) FILTER (id % 100 = 7) = 0 AS chain_valid, min(CASE WHEN id % 100 = 7 THEN height END) AS first_break, CASE WHEN count(*) FILTER (id % 100 = 7) > 0 THEN 'leaf' END AS reason FROM chain GROUP BY tenant_id")
def w05_audit_chain(spark, d):
    recomputed = F.when(F.col("id") % 100 == 7, F.lit("tampered")).otherwise(F.sha2(F.concat_ws("|", F.col("id").cast("string"), "event_type"), 256))
    return chain.audit_chain(_chain(spark, d), recomputed)


@query(_CHAIN_SQL + " SELECT c.tenant_id, c.id, c.leaf_hash, c.parent_root, c.height, r.root_hash, r.height - c.height AS proof_length, true AS included FROM chain c JOIN (SELECT tenant_id, arg_max(root_hash, height) AS root_hash, max(height) AS height FROM chain GROUP BY tenant_id) r USING (tenant_id) WHERE c.id IN (3, 500, 901)")
def w06_inclusion_proof(spark, d):
    return chain.inclusion_proof(_chain(spark, d), [3, 500, 901]).withColumn("proof_length", F.col("proof_length").cast("long"))


@query(
    _CHAIN_SQL
    + """, tree AS (SELECT * FROM (WITH RECURSIVE t AS (
    SELECT tenant_id, 0 AS level, height - 1 AS pos, sha256(concat('leaf|', leaf_hash)) AS hash, count(*) OVER (PARTITION BY tenant_id) AS n FROM chain
    UNION ALL SELECT tenant_id, level + 1, pos // 2, CASE WHEN other IS NULL THEN hash ELSE sha256(concat('node|', hash, other)) END, (n + 1) // 2
    FROM (SELECT *, lead(hash) OVER (PARTITION BY tenant_id ORDER BY pos) AS other FROM t WHERE n > 1) WHERE pos % 2 = 0
) SELECT * FROM t)) SELECT tenant_id, hash AS tree_root FROM tree WHERE n = 1"""
)
def w06_tree_roots(spark, d):
    return chain.tree_roots(chain.hash_tree(_chain(spark, d)))


@query(_CHAIN_SQL + ", n AS (SELECT tenant_id, max(height) AS n FROM chain GROUP BY tenant_id) SELECT tenant_id, id, height, CAST(len(list_filter(range(0, 40), lambda k: xor((height - 1) >> k, 1) < ((n - 1) >> k) + 1)) AS BIGINT) AS n_hashes, true AS included FROM chain JOIN n USING (tenant_id)")
def w06_tree_proofs(spark, d):
    """A short proof of every write against its tenant's tree, and whether it verifies."""
    rows = written(chain.chain(leafed(adapted(spark, d, "writes")).select("tenant_id", "id", "ts", "leaf_hash"), ["ts", "id"]).select("tenant_id", "id", "leaf_hash", "height"), "zstd")
    tree = chain.hash_tree(rows)
    proofs = chain.tree_proofs(rows, tree, rows).withColumn("n_hashes", F.size("proof").cast("long"))
    return chain.verify_tree_proofs(proofs, chain.tree_roots(tree)).select("tenant_id", "id", "height", "n_hashes", "included")


@query(f"""{cte('writes')}, e AS (SELECT id, tenant_id, event_type AS decision_id, sha256(props) AS evidence_hash, ts FROM writes)
SELECT id, evidence_hash, lag(evidence_hash, 1, repeat('0', 64)) OVER (PARTITION BY tenant_id, decision_id ORDER BY ts, id) AS prev_hash FROM e""")
def w07_evidence_chain(spark, d):
    blocks = adapted(spark, d, "writes").select("id", "tenant_id", F.col("event_type").alias("decision_id"), F.col("props").alias("payload"), F.col("ts").alias("created_at"))
    return chain.evidence_chain(blocks).select("id", "evidence_hash", "prev_hash")


@query(f"{cte('writes')} SELECT tenant_id, event_type AS decision_id, arg_max(id, struct_pack(a := ts, b := id)) AS id, arg_max(sha256(props), struct_pack(a := ts, b := id)) AS evidence_hash FROM writes GROUP BY ALL")
def t05_latest_evidence(spark, d):
    blocks = adapted(spark, d, "writes").select("id", "tenant_id", F.col("event_type").alias("decision_id"), F.col("props").alias("payload"), F.col("ts").alias("created_at"))
    return chain.latest_evidence(chain.evidence_chain(blocks))


_EPOCHS_SQL = (
    _CHAIN_SQL
    + """, epochs AS (SELECT tenant_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 86400 AS epoch_unix, arg_max(root_hash, height) AS root_hash, max(height) AS block_height FROM chain GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY epoch_unix) AS rn FROM epochs),
snapshots AS (SELECT * FROM (WITH RECURSIVE s AS (
    SELECT *, '' AS parent_snapshot_hash, sha256(concat(tenant_id, '|', root_hash, '|', CAST(block_height AS VARCHAR), '||', CAST(epoch_unix AS VARCHAR))) AS snapshot_hash FROM numbered WHERE rn = 1
    UNION ALL SELECT n.*, s.snapshot_hash, sha256(concat(n.tenant_id, '|', n.root_hash, '|', CAST(n.block_height AS VARCHAR), '|', s.snapshot_hash, '|', CAST(n.epoch_unix AS VARCHAR))) FROM s JOIN numbered n ON n.tenant_id = s.tenant_id AND n.rn = s.rn + 1
) SELECT * FROM s))"""
)


def _snapshots(spark, d):
    return chain.snapshot_chain(chain.roots_by_window(_chain(spark, d), "ts", "1 day"))


@query(_EPOCHS_SQL + " SELECT tenant_id, epoch_unix, block_height, parent_snapshot_hash, snapshot_hash FROM snapshots")
def w08_r07_snapshot_chain(spark, d):
    return _snapshots(spark, d).select("tenant_id", "epoch_unix", "block_height", "parent_snapshot_hash", "snapshot_hash")


@query(_EPOCHS_SQL + " SELECT tenant_id, arg_max(snapshot_hash, epoch_unix) AS snapshot_hash, max(epoch_unix) AS epoch_unix FROM snapshots GROUP BY tenant_id")
def t03_latest_snapshot(spark, d):
    return filters.latest_snapshot(_snapshots(spark, d)).select("tenant_id", "snapshot_hash", "epoch_unix")


@query(_EPOCHS_SQL + " SELECT epoch_unix, snapshot_hash FROM snapshots WHERE tenant_id = '5' ORDER BY epoch_unix DESC LIMIT 20")
def t04_list_snapshots(spark, d):
    return filters.list_snapshots(_snapshots(spark, d), "5", 101).select("epoch_unix", "snapshot_hash")


@query(_EPOCHS_SQL + ", last AS (SELECT tenant_id, arg_max(snapshot_hash, epoch_unix) AS p, arg_max(root_hash, epoch_unix) AS r, max(block_height) AS h FROM snapshots GROUP BY tenant_id) SELECT tenant_id, p AS parent_snapshot_hash, sha256(concat(tenant_id, '|', r, '|', CAST(h AS VARCHAR), '|', p, '|1735689600')) AS snapshot_hash FROM last")
def j05_snapshot_step(spark, d):
    roots = chain.chain_roots(_chain(spark, d))
    return chain.snapshot_step(roots, _snapshots(spark, d), F.timestamp_seconds(F.lit(1735689600))).select("tenant_id", "parent_snapshot_hash", "snapshot_hash")


@query(_CHAIN_SQL + " SELECT c.id, c.height, r.root_hash AS tenant_root, r.height AS tenant_height, true AS is_verified FROM chain c JOIN (SELECT tenant_id, arg_max(root_hash, height) AS root_hash, max(height) AS height FROM chain GROUP BY tenant_id) r USING (tenant_id)")
def j04_proofs(spark, d):
    rows = _chain(spark, d)
    return chain.proofs(rows, chain.chain_roots(rows)).select("id", "height", "tenant_root", "tenant_height", "is_verified")


@query(_EPOCHS_SQL + " SELECT tenant_id, snapshot_hash FROM snapshots")
def u02_dedupe_snapshots(spark, d):
    rows = _snapshots(spark, d).select("tenant_id", "snapshot_hash")
    return evidence.dedupe_snapshots(rows.unionByName(rows))


# --- Budgets -------------------------------------------------------------------------------------------------------

_METER_SQL = f"""{cte('requests')}, n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, request_id) AS rn FROM requests),
metered AS (SELECT * FROM (WITH RECURSIVE m AS (
    SELECT tenant_id, request_id, rn, {BALANCE} - tokens_used >= 0 AS allowed, CASE WHEN {BALANCE} - tokens_used >= 0 THEN {BALANCE} - tokens_used ELSE {BALANCE} END AS remaining_tokens, CASE WHEN {BALANCE} - tokens_used >= 0 THEN 59 ELSE 60 END AS remaining_executions, CASE WHEN {BALANCE} - tokens_used >= 0 THEN 'active' ELSE 'exhausted' END AS table_status FROM n WHERE rn = 1
    UNION ALL SELECT n.tenant_id, n.request_id, n.rn, ok, CASE WHEN ok THEN left_t - n.tokens_used ELSE left_t END, CASE WHEN ok THEN left_e - 1 ELSE left_e END, CASE WHEN ok THEN st ELSE 'exhausted' END
    FROM (SELECT n.*, m.remaining_tokens AS left_t, m.remaining_executions AS left_e, m.table_status AS st, m.remaining_tokens - n.tokens_used >= 0 AND m.remaining_executions - 1 >= 0 AS ok FROM m JOIN n ON n.tenant_id = m.tenant_id AND n.rn = m.rn + 1) n
) SELECT * FROM m))"""


def _metered(spark, d):
    return budget.meter(adapted(spark, d, "requests"), ["ts", "request_id"], BALANCE, 60)


@query(_METER_SQL + " SELECT request_id, allowed, CAST(remaining_tokens AS BIGINT) AS remaining_tokens, CAST(remaining_executions AS BIGINT) AS remaining_executions, CASE WHEN allowed THEN 'active' ELSE 'exhausted' END AS response_status, table_status FROM metered")
def w09_meter(spark, d):
    return _metered(spark, d).select("request_id", "allowed", "remaining_tokens", "remaining_executions", "response_status", "table_status")


@query(_METER_SQL + " SELECT tenant_id, CAST(arg_max(remaining_tokens, rn) AS BIGINT) AS token_balance, CAST(arg_max(remaining_executions, rn) AS BIGINT) AS executions_left, arg_max(table_status, rn) AS status, count(*) FILTER (NOT allowed) AS denials FROM metered GROUP BY tenant_id")
def w09_final_budgets(spark, d):
    return budget.final_budgets(_metered(spark, d), ["ts", "request_id"])


_DRAW_SQL = f"""{_BUDGETS_SQL}, n AS (SELECT r.*, b.token_balance AS start, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, request_id) AS rn FROM requests r LEFT JOIN budgets b USING (tenant_id)),
drawn AS (SELECT * FROM (WITH RECURSIVE m AS (
    SELECT tenant_id, request_id, rn, CASE WHEN tokens_used <= start THEN start - tokens_used ELSE start END AS remaining_after, CASE WHEN start IS NULL THEN 'no budget' WHEN tokens_used > start THEN 'insufficient budget' END AS error FROM n WHERE rn = 1
    UNION ALL SELECT n.tenant_id, n.request_id, n.rn, CASE WHEN n.tokens_used <= m.remaining_after THEN m.remaining_after - n.tokens_used ELSE m.remaining_after END, CASE WHEN m.remaining_after IS NULL THEN 'no budget' WHEN n.tokens_used > m.remaining_after THEN 'insufficient budget' END FROM m JOIN n ON n.tenant_id = m.tenant_id AND n.rn = m.rn + 1
) SELECT * FROM m))"""


@query(_DRAW_SQL + " SELECT request_id, CAST(remaining_after AS BIGINT) AS remaining_after, error FROM drawn")
def w10_draw_down(spark, d):
    return budget.draw_down(adapted(spark, d, "requests"), _budgets(spark, d), ["ts", "request_id"]).select("request_id", "remaining_after", "error")


@query(f"{cte('requests')} SELECT request_id, CAST(sum(tokens_used) OVER w AS BIGINT) AS spent, round(CAST(sum(tokens_used) OVER w AS BIGINT) / {BALANCE}.0, 6) AS share FROM requests WINDOW w AS (PARTITION BY tenant_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING)".replace("3000.0", "CAST(3000 AS DOUBLE)"))
def w11_running_spend(spark, d):
    return budget.running_spend(adapted(spark, d, "requests"), ["ts", "request_id"], BALANCE).select("request_id", "spent", "share")


@query(f"{cte('requests')} SELECT tenant_id, agent_id, operation, CAST(sum(tokens_used) AS BIGINT) AS tokens, CAST(sum(executions_used) AS BIGINT) AS executions, count(*) AS entries, CAST(grouping_id(tenant_id, agent_id, operation) AS BIGINT) AS level FROM requests GROUP BY ROLLUP (tenant_id, agent_id, operation)")
def a11_ledger_rollup(spark, d):
    return budget.ledger_rollup(adapted(spark, d, "requests"), ["tenant_id", "agent_id", "operation"])


# --- Temporal ------------------------------------------------------------------------------------------------------

_ACTIVE = f"valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '{AT}')"


@query(f"{cte('decisions')} SELECT {_BRIEF_SQL} FROM decisions WHERE {_ACTIVE} AND status IN ('canonical', 'approved', 'draft')")
def b01_active_at(spark, d):
    return temporal.active_at(adapted(spark, d, "decisions"), _at(), statuses=temporal.DEFAULT_STATUSES).select(*_BRIEF)


@query(f"{cte('decisions')} SELECT id, {sql_text('moment')} AS moment FROM decisions JOIN (SELECT DISTINCT CAST(date_trunc('day', ts) - INTERVAL 2200 DAY AS TIMESTAMP) AS moment FROM events) ON valid_from <= moment AND (valid_to IS NULL OR valid_to >= moment)")
def b02_j07_active_at_each(spark, d):
    """What was in force at each day that has events, as many days earlier as the orders are older."""
    instants = table(spark, d, "events").select((F.date_trunc("day", "ts") - F.expr("INTERVAL '2200' DAY")).cast("timestamp_ntz").alias("moment")).distinct()
    return text_of(temporal.active_at_each(instants, adapted(spark, d, "decisions"), "moment").select("id", "moment"), "moment")


@query(f"{cte('decisions')} SELECT tenant_id, id, {sql_text('valid_from')} AS valid_from FROM decisions WHERE tenant_id = '3' AND customer = 13")
def b03_history(spark, d):
    writes = adapted(spark, d, "decisions").withColumn("version", F.col("id")).withColumn("id", F.col("customer")).withColumn("updated_at", F.col("created_at"))
    return text_of(temporal.history(writes, "3", 13).select("tenant_id", F.col("version").alias("id"), "valid_from"), "valid_from")


@query(f"{cte('decisions')} SELECT tenant_id, customer AS id, arg_max(id, struct_pack(a := created_at, b := id)) AS version FROM decisions WHERE created_at <= TIMESTAMP '{AT}' GROUP BY ALL")
def b04_as_recorded(spark, d):
    writes = adapted(spark, d, "decisions").withColumn("version", F.col("id")).withColumn("id", F.col("customer")).withColumn("updated_at", F.col("created_at"))
    # ties of one customer on one day: the later order counts
    return temporal.as_recorded(writes, _at(), ["version"]).select("tenant_id", "id", "version")


@query(f"{cte('decisions')} SELECT id, CASE WHEN valid_to < TIMESTAMP '{AT}' THEN 'stale' ELSE status END AS status FROM decisions")
def b05_mark_expired(spark, d):
    rows = adapted(spark, d, "decisions").withColumn("updated_at", F.col("created_at"))
    return temporal.mark_expired(rows, _at(), F.col("valid_to")).select("id", "status")


@query(f"{cte('checkpoints')} SELECT id, CASE WHEN ttl_seconds > 0 THEN strftime(created_at + to_seconds(ttl_seconds), '%Y-%m-%d %H:%M:%S') END AS expires_at, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS valid_from FROM checkpoints")
def b06_b07_expiry_and_backfill(spark, d):
    rows = temporal.with_expiry(adapted(spark, d, "checkpoints")).withColumn("valid_from", F.when(F.col("id") % 2 == 0, F.col("created_at")))
    return text_of(temporal.backfill_validity(rows).select("id", "expires_at", "valid_from"), "expires_at", "valid_from")


# --- Lineage -------------------------------------------------------------------------------------------------------


@query(f"{cte('nodes')} SELECT n.id, p.title AS parent_title, p.id IS NOT NULL AS has_parent FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id")
def j01_with_parent(spark, d):
    return graph.with_parent(adapted(spark, d, "nodes")).select("id", "parent_title", "has_parent")


@query(f"{cte('nodes')} SELECT n.id, coalesce(string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.id), '') AS children FROM nodes n LEFT JOIN nodes c ON c.parent_id = n.id GROUP BY n.id")
def j02_with_children(spark, d):
    return graph.with_children(adapted(spark, d, "nodes")).select("id", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


@query(f"{cte('nodes')} SELECT p_partkey AS id, EXISTS (SELECT 1 FROM nodes WHERE id = p_partkey * 7) AS known FROM part")
def j03_register(spark, d):
    asked = table(spark, d, "part").select(F.lit("all").alias("tenant_id"), (F.col("p_partkey") * 7).alias("id"))
    known, unknown = graph.register(asked, adapted(spark, d, "nodes"))
    both = known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))
    return both.select((F.col("id") / 7).cast("long").alias("id"), "known")


@query(f"{cte('nodes')} SELECT parent_id AS id, count(*) AS n_children FROM nodes WHERE parent_id IN (1, 2, 40) GROUP BY 1")
def a12_direct_impact(spark, d):
    return graph.direct_impact(adapted(spark, d, "nodes"), [1, 2, 40]).select("id", "n_children")


# A batch of all kinds: related edges as they are, dependencies again, supersedes edges turned round, and self edges.
_NEW_EDGES = "SELECT from_id, to_id, edge_type, created_at FROM {0}edges{1} WHERE edge_type <> 'supersedes' UNION ALL SELECT to_id AS from_id, from_id AS to_id, 'related_to' AS edge_type, created_at FROM {0}edges{1} WHERE edge_type = 'supersedes' UNION ALL SELECT from_id, from_id AS to_id, edge_type, created_at FROM {0}edges{1} WHERE edge_type = 'supersedes'"


@query(f"""{cte('edges')}, fresh AS ({_NEW_EDGES.format('', '')}), old AS (SELECT * FROM edges WHERE edge_type <> 'related_to')
SELECT DISTINCT from_id, to_id, edge_type, CASE WHEN from_id = to_id THEN 'self_edge' WHEN EXISTS (SELECT 1 FROM old o WHERE o.from_id = f.from_id AND o.to_id = f.to_id AND o.edge_type = f.edge_type) THEN 'duplicate' WHEN EXISTS (SELECT 1 FROM old o WHERE o.from_id = f.to_id AND o.to_id = f.from_id) THEN 'cycle' END AS reject_reason FROM fresh f""")
def g01_g02_add_edges(spark, d):
    edges = adapted(spark, d, "edges")
    fresh = spark.sql(_NEW_EDGES.format("{", "}"), edges=edges)
    return graph.add_edges(edges.filter("edge_type <> 'related_to'"), fresh).select("from_id", "to_id", "edge_type", "reject_reason")


@query(f"{cte('edges')} SELECT count(DISTINCT n) AS nodes, count(DISTINCT n) <= 1000 AS within_limit FROM (SELECT from_id AS n FROM edges UNION ALL SELECT to_id FROM edges)")
def g03_check_limit(spark, d):
    return graph.check_limit(adapted(spark, d, "edges"))


_SEEDS = "(1, 2, 5, 13, 40)"


@query(f"{cte('edges')} SELECT to_id AS id, from_id AS dependent FROM edges WHERE edge_type = 'depends_on' AND to_id IN {_SEEDS}")
def g04_children(spark, d):
    edges = adapted(spark, d, "edges")
    return graph.children(edges, edges.filter(f"from_id IN {_SEEDS}").select(F.col("from_id").alias("id")))


@query(f"{cte('edges')} SELECT from_id AS id, to_id AS dependency FROM edges WHERE edge_type = 'depends_on' AND from_id IN {_SEEDS}")
def g05_parents(spark, d):
    edges = adapted(spark, d, "edges")
    return graph.parents(edges, edges.filter(f"from_id IN {_SEEDS}").select(F.col("from_id").alias("id")))


@query(f"""{cte('edges')}, links AS (SELECT to_id AS id, arg_min(from_id, struct_pack(a := created_at, b := from_id)) AS next FROM edges WHERE edge_type = 'supersedes' GROUP BY to_id)
SELECT * FROM (WITH RECURSIVE w AS (SELECT id, 0 AS pos, id AS member FROM (SELECT DISTINCT to_id AS id FROM edges) UNION ALL SELECT w.id, w.pos + 1, l.next FROM w JOIN links l ON l.id = w.member WHERE l.next <> l.id) SELECT id, pos, member FROM w)""")
def g06_superseding_chain(spark, d):
    edges = adapted(spark, d, "edges")
    return graph.superseding_chain(edges, edges.select(F.col("to_id").alias("id")))


@query(f"{cte('nodes')} SELECT * FROM (WITH RECURSIVE w AS (SELECT id, 0 AS pos, id AS member FROM nodes UNION ALL SELECT w.id, w.pos + 1, n.parent_id FROM w JOIN nodes n ON n.id = w.member WHERE n.parent_id IS NOT NULL) SELECT id, pos, member FROM w)")
def g07_ancestor_chain(spark, d):
    rows = adapted(spark, d, "nodes")
    return graph.ancestor_chain(rows, rows).select("id", "pos", "member")


@query(f"""{cte('edges')} SELECT * FROM (WITH RECURSIVE r AS (SELECT to_id AS seed, from_id AS id, 1 AS depth FROM edges WHERE edge_type = 'depends_on' AND to_id IN {_SEEDS} AND from_id <> to_id UNION ALL SELECT r.seed, e.from_id, r.depth + 1 FROM r JOIN edges e ON e.to_id = r.id AND e.edge_type = 'depends_on' AND e.from_id <> e.to_id) SELECT seed, id, depth FROM r)""")
def g08_impact_edges(spark, d):
    edges = adapted(spark, d, "edges")
    return graph.impact_edges(edges, edges.filter(f"from_id IN {_SEEDS}").select(F.col("from_id").alias("id")))


@query(f"{cte('nodes')} SELECT * FROM (WITH RECURSIVE r AS (SELECT parent_id AS seed, id, 1 AS depth FROM nodes WHERE parent_id IN {_SEEDS} UNION ALL SELECT r.seed, n.id, r.depth + 1 FROM r JOIN nodes n ON n.parent_id = r.id) SELECT seed, id, depth FROM r)")
def g09_impact_set(spark, d):
    rows = adapted(spark, d, "nodes")
    return graph.impact_set(rows, rows.filter(f"id IN {_SEEDS}")).select("seed", "id", "depth")


@query(f"""{cte('nodes', 'edges')}, v AS (SELECT n.id, n.title, n.parent_id, p.title AS parent_title FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id WHERE n.id IN {_SEEDS}),
k AS (SELECT parent_id AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS children FROM nodes GROUP BY 1),
dy AS (SELECT from_id AS id, string_agg(CAST(to_id AS VARCHAR), ',' ORDER BY to_id) AS s FROM edges WHERE edge_type = 'depends_on' GROUP BY 1),
dt AS (SELECT to_id AS id, string_agg(CAST(from_id AS VARCHAR), ',' ORDER BY from_id) AS s FROM edges WHERE edge_type = 'depends_on' GROUP BY 1),
an AS (SELECT id, string_agg(CAST(member AS VARCHAR), ',' ORDER BY pos) AS s FROM (WITH RECURSIVE w AS (SELECT id, 0 AS pos, id AS member FROM nodes WHERE id IN {_SEEDS} UNION ALL SELECT w.id, w.pos + 1, n.parent_id FROM w JOIN nodes n ON n.id = w.member WHERE n.parent_id IS NOT NULL) SELECT * FROM w) GROUP BY id),
im AS (SELECT seed AS id, count(*) AS n FROM (WITH RECURSIVE r AS (SELECT parent_id AS seed, id FROM nodes WHERE parent_id IN {_SEEDS} UNION ALL SELECT r.seed, n.id FROM r JOIN nodes n ON n.parent_id = r.id) SELECT * FROM r) GROUP BY seed)
SELECT v.*, coalesce(k.children, '') AS children, coalesce(dy.s, '') AS dependencies, coalesce(dt.s, '') AS dependents, coalesce(an.s, '') AS ancestors, coalesce(im.n, 0) AS impact FROM v LEFT JOIN k USING (id) LEFT JOIN dy USING (id) LEFT JOIN dt USING (id) LEFT JOIN an USING (id) LEFT JOIN im USING (id)""")
def g10_g11_lineage(spark, d):
    rows = adapted(spark, d, "nodes")
    return graph.lineage(rows, adapted(spark, d, "edges"), rows.filter(f"id IN {_SEEDS}")).drop("tenant_id")


@query(f"{cte('edges')} SELECT from_id, to_id, edge_type FROM edges WHERE from_id % 3 <> 0 AND to_id % 3 <> 0")
def g12_remove_nodes(spark, d):
    edges = adapted(spark, d, "edges")
    gone = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).filter("id % 3 = 0")
    return graph.remove_nodes(edges, gone).select("from_id", "to_id", "edge_type")


# The same operators asked about every 49th id (a step that meets all edge types), and the cycle check over all parts: the work grows with the tables.

_MANY = "(SELECT event_id FROM events WHERE event_id % 49 = 0)"
_ALL_SQUARES = "SELECT p_partkey AS from_id, (p_partkey * p_partkey + 1) % (SELECT greatest(count(*) - 1, 1) FROM {0}part{1}) + 1 AS to_id FROM {0}part{1}"


def _every_49th(rows: DataFrame, column: str = "id") -> DataFrame:
    return rows.filter(f"{column} % 49 = 0").select(F.col(column).alias("id"))


@query(ORACLES["a12_direct_impact"].replace("(1, 2, 40)", _MANY))
def a12_direct_impact_many(spark, d):
    rows = adapted(spark, d, "nodes")
    return graph.direct_impact(rows, _every_49th(rows)).select("id", "n_children")


@query(ORACLES["g04_children"].replace(_SEEDS, _MANY))
def g04_children_many(spark, d):
    edges = adapted(spark, d, "edges")
    return graph.children(edges, _every_49th(edges, "from_id"))


@query(ORACLES["g05_parents"].replace(_SEEDS, _MANY))
def g05_parents_many(spark, d):
    edges = adapted(spark, d, "edges")
    return graph.parents(edges, _every_49th(edges, "from_id"))


@query(ORACLES["g08_impact_edges"].replace(_SEEDS, _MANY))
def g08_impact_edges_many(spark, d):
    edges = adapted(spark, d, "edges")
    return graph.impact_edges(edges, _every_49th(edges, "from_id"))


@query(ORACLES["g09_impact_set"].replace(_SEEDS, _MANY))
def g09_impact_set_many(spark, d):
    rows = adapted(spark, d, "nodes")
    return graph.impact_set(rows, rows.filter("id % 49 = 0")).select("seed", "id", "depth")


@query(ORACLES["g10_g11_lineage"].replace(_SEEDS, _MANY))
def g10_g11_lineage_many(spark, d):
    rows = adapted(spark, d, "nodes")
    return graph.lineage(rows, adapted(spark, d, "edges"), rows.filter("id % 49 = 0")).drop("tenant_id")


@query(f"WITH f AS ({_ALL_SQUARES.format('', '')}) SELECT DISTINCT x AS id FROM (WITH RECURSIVE s AS (SELECT 0 AS i, from_id AS x FROM f UNION SELECT s.i + 1, f.to_id FROM s JOIN f ON f.from_id = s.x WHERE s.i < 1000) SELECT * FROM s) WHERE i = 1000 AND x NOT IN (SELECT from_id FROM f WHERE from_id = to_id)")
def g13_validate_all(spark, d):
    return graph.validate(spark.sql(_ALL_SQUARES.format("{", "}"), part=table(spark, d, "part")))


# Two tenants that have the same ids: no path, impact or record of one has a row of the other.


@query(f"{cte('forest')} SELECT * FROM (WITH RECURSIVE w AS (SELECT tenant_id, id, 0 AS pos, id AS member FROM forest WHERE id % 7 = 0 UNION ALL SELECT w.tenant_id, w.id, w.pos + 1, n.parent_id FROM w JOIN forest n ON n.tenant_id = w.tenant_id AND n.id = w.member WHERE n.parent_id IS NOT NULL) SELECT * FROM w)")
def g07_ancestor_chain_tenants(spark, d):
    rows = adapted(spark, d, "forest")
    return graph.ancestor_chain(rows, rows.filter("id % 7 = 0"))


@query(f"{cte('forest')} SELECT * FROM (WITH RECURSIVE r AS (SELECT tenant_id, parent_id AS seed, id, 1 AS depth FROM forest WHERE parent_id % 49 = 0 AND parent_id > 0 UNION ALL SELECT r.tenant_id, r.seed, n.id, r.depth + 1 FROM r JOIN forest n ON n.tenant_id = r.tenant_id AND n.parent_id = r.id) SELECT * FROM r)")
def g09_impact_set_tenants(spark, d):
    rows = adapted(spark, d, "forest").filter("id > 0")
    return graph.impact_set(rows, rows.filter("id % 49 = 0"))


@query(f"""{cte('forest', 'edges')}, v AS (SELECT n.tenant_id, n.id, n.title, n.parent_id, p.title AS parent_title FROM forest n LEFT JOIN forest p ON p.tenant_id = n.tenant_id AND p.id = n.parent_id WHERE n.id % 49 = 0 AND n.id > 0),
k AS (SELECT tenant_id, parent_id AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS children FROM forest GROUP BY ALL),
dy AS (SELECT from_id AS id, string_agg(CAST(to_id AS VARCHAR), ',' ORDER BY to_id) AS s FROM edges WHERE edge_type = 'depends_on' GROUP BY 1),
dt AS (SELECT to_id AS id, string_agg(CAST(from_id AS VARCHAR), ',' ORDER BY from_id) AS s FROM edges WHERE edge_type = 'depends_on' GROUP BY 1),
an AS (SELECT tenant_id, id, string_agg(CAST(member AS VARCHAR), ',' ORDER BY pos) AS s FROM (WITH RECURSIVE w AS (SELECT tenant_id, id, 0 AS pos, id AS member FROM v UNION ALL SELECT w.tenant_id, w.id, w.pos + 1, n.parent_id FROM w JOIN forest n ON n.tenant_id = w.tenant_id AND n.id = w.member WHERE n.parent_id IS NOT NULL) SELECT * FROM w) GROUP BY ALL),
im AS (SELECT tenant_id, seed AS id, count(*) AS n FROM (WITH RECURSIVE r AS (SELECT n.tenant_id, n.parent_id AS seed, n.id FROM forest n JOIN v ON v.tenant_id = n.tenant_id AND v.id = n.parent_id UNION ALL SELECT r.tenant_id, r.seed, n.id FROM r JOIN forest n ON n.tenant_id = r.tenant_id AND n.parent_id = r.id) SELECT * FROM r) GROUP BY ALL)
SELECT v.*, coalesce(k.children, '') AS children, coalesce(dy.s, '') AS dependencies, coalesce(dt.s, '') AS dependents, coalesce(an.s, '') AS ancestors, coalesce(im.n, 0) AS impact FROM v LEFT JOIN k USING (tenant_id, id) LEFT JOIN dy USING (id) LEFT JOIN dt USING (id) LEFT JOIN an USING (tenant_id, id) LEFT JOIN im USING (tenant_id, id)""")
def g10_g11_lineage_tenants(spark, d):
    rows = adapted(spark, d, "forest")
    return graph.lineage(rows, adapted(spark, d, "edges"), rows.filter("id % 49 = 0 AND id > 0"))


# --- Harvest, evidence, checkpoints --------------------------------------------------------------------------------


#: As above with messages without a text, which have no match.
_EXTRACT_SQL = _HARVEST_SQL.replace("regexp_extract_all(text,", "regexp_extract_all(coalesce(text, ''),").replace(" WHERE coalesce(text, '') <> ''", "")


@query(_EXTRACT_SQL + "SELECT channel_id, ts, CAST(n_matches AS INTEGER) AS n_matches, extracted_decision, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM h")
def h01_extract(spark, d):
    rows = adapted(spark, d, "messages")
    return harvest.extract(rows, "text", KEYWORDS).select("channel_id", "ts", "n_matches", "extracted_decision", F.round("confidence", 6).alias("confidence"))


@query(_EXTRACT_SQL + "SELECT channel_id, ts, CASE WHEN ts < '2' THEN 'kept' ELSE extracted_decision END AS extracted_decision, CAST(CASE WHEN ts < '2' THEN 0.85 ELSE round(confidence, 6) END AS DOUBLE) AS confidence FROM h")
def h02_extract_with_context(spark, d):
    rows = adapted(spark, d, "messages").withColumn("prior", F.when(F.col("ts") < "2", "kept").otherwise(""))
    return harvest.extract_with_context(rows, "text", "prior", KEYWORDS).select("channel_id", "ts", "extracted_decision", F.round("confidence", 6).alias("confidence"))


@query(_HARVEST_SQL + f"SELECT {_UUID_SQL.format('source_id')} AS id, source_id, source_url, extracted_decision, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM h WHERE confidence >= 0.7")
def h03_harvest(spark, d):
    return harvest.harvest(adapted(spark, d, "messages"), KEYWORDS).select("id", "source_id", "source_url", "extracted_decision", F.round("confidence", 6).alias("confidence"))


@query(_HARVEST_SQL + "SELECT source_id, confidence >= 0.9 AS human_validated, confidence >= 0.9 AS linked, CASE WHEN confidence >= 0.9 THEN extracted_decision END AS title FROM h WHERE confidence >= 0.7")
def h04_j10_promote(spark, d):
    decisions, marked = harvest.promote(harvest.harvest(adapted(spark, d, "messages"), KEYWORDS), 0.9, "promoter", "t1", _at())
    titles = decisions.select(F.col("id").alias("decision_id"), "title")
    return marked.join(titles, "decision_id", "left").select("source_id", "human_validated", F.col("decision_id").isNotNull().alias("linked"), "title")


_EVIDENCE_SQL = cte("evidence") + ", e AS (SELECT tenant_id, sha256(coalesce(content, '')) AS block_hash, created_at FROM evidence)"


@query(_EVIDENCE_SQL + " SELECT tenant_id, block_hash, min(created_at) AS created_at, 1 AS ref_count FROM e GROUP BY ALL")
def u01_u04_ingest_evidence(spark, d):
    docs = adapted(spark, d, "evidence")
    nothing = evidence.hashed(docs.limit(0)).withColumn("ref_count", F.lit(1))
    return evidence.ingest_evidence(nothing, docs).select("tenant_id", "block_hash", "created_at", "ref_count")


@query(_EVIDENCE_SQL + ", old AS (SELECT tenant_id, block_hash, max(created_at) AS created_at, 7 AS ref_count FROM e WHERE created_at % 2 = 1 GROUP BY ALL) SELECT * FROM old UNION ALL SELECT tenant_id, block_hash, min(created_at), 1 FROM e WHERE (tenant_id, block_hash) NOT IN (SELECT (tenant_id, block_hash) FROM old) GROUP BY ALL")
def u01_ingest_over_existing(spark, d):
    """What is there stays as it is, although the incoming rows have earlier ones with its hash."""
    docs = adapted(spark, d, "evidence")
    old = evidence.hashed(docs.filter("created_at % 2 = 1")).groupBy("tenant_id", "block_hash").agg(F.max_by("content", "created_at").alias("content"), F.max("created_at").alias("created_at")).withColumn("ref_count", F.lit(7))
    return evidence.ingest_evidence(old, docs).select("tenant_id", "block_hash", "created_at", "ref_count")


@query(_EVIDENCE_SQL + " SELECT block_hash, count(*) AS ref_count, min(created_at) AS created_at FROM e GROUP BY block_hash")
def a07_upsert_blocks(spark, d):
    rows = evidence.hashed(adapted(spark, d, "evidence")).select("block_hash", "content", F.lit(1).alias("ref_count"), "created_at")
    return evidence.upsert_blocks(rows.filter("created_at % 2 = 0"), rows.filter("created_at % 2 = 1")).select("block_hash", "ref_count", "created_at")


_DELTA_SQL = _EVIDENCE_SQL + ", c AS (SELECT block_hash AS hash, CASE WHEN created_at % 3 = 0 THEN -1 ELSE 1 END AS delta FROM e WHERE created_at % 17 <> 0), net AS (SELECT hash, CAST(sum(delta) AS BIGINT) AS delta FROM c GROUP BY hash HAVING sum(delta) <> 0)"


def _changes(spark, d):
    rows = evidence.hashed(adapted(spark, d, "evidence"))
    delta = F.when(F.col("created_at") % 17 == 0, "x").when(F.col("created_at") % 3 == 0, "-1").otherwise("1")
    return rows.select(F.upper("block_hash").alias("hash"), delta.alias("delta"))


@query(_DELTA_SQL + " SELECT hash, delta FROM net")
def a08_net_deltas(spark, d):
    return evidence.net_deltas(_changes(spark, d))


@query(_DELTA_SQL + " SELECT t.block_hash, 10 + coalesce(net.delta, 0) AS ref_count FROM (SELECT DISTINCT block_hash FROM e) t LEFT JOIN net ON net.hash = t.block_hash")
def j08_apply_deltas(spark, d):
    blocks = evidence.hashed(adapted(spark, d, "evidence")).select("block_hash", F.lit(10).alias("ref_count")).distinct()
    return evidence.apply_deltas(blocks, evidence.net_deltas(_changes(spark, d)))


@query(f"{cte('checkpoints')} SELECT id, agent_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, agent_id ORDER BY created_at DESC, id) AS rn FROM checkpoints) WHERE rn <= 3")
def t02_top_checkpoints(spark, d):
    return filters.top_checkpoints(adapted(spark, d, "checkpoints"), 3).select("id", "agent_id")


@query(f"{cte('checkpoints')} SELECT tenant_id, agent_id, task_id, checkpoint_data, 'active' AS status, CASE WHEN ttl_seconds > 0 THEN strftime(created_at + to_seconds(ttl_seconds), '%Y-%m-%d %H:%M:%S') END AS expires_at FROM (SELECT DISTINCT tenant_id, agent_id, task_id, checkpoint_data, created_at, ttl_seconds FROM checkpoints)")
def p01_save_checkpoints(spark, d):
    requests = adapted(spark, d, "checkpoints").select("tenant_id", "agent_id", "task_id", "checkpoint_data", "created_at", "ttl_seconds").distinct()
    return text_of(checkpoints.save_checkpoints(requests).select("tenant_id", "agent_id", "task_id", "checkpoint_data", "status", "expires_at"), "expires_at")


def _stored(spark, d):
    return temporal.with_expiry(adapted(spark, d, "checkpoints")).withColumn("updated_at", F.col("created_at")).select(*checkpoints.COLUMNS)


@query(f"{cte('checkpoints')} SELECT id, agent_id, checkpoint_data FROM checkpoints WHERE id % 50 = 0")
def p02_resume(spark, d):
    rows = _stored(spark, d)
    return checkpoints.resume(rows, rows.filter("id % 50 = 0")).select("id", "agent_id", "checkpoint_data")


@query(f"{cte('checkpoints')} SELECT concat('to-', CAST(id AS VARCHAR)) AS agent_id, agent_id AS from_agent_id, checkpoint_data, 'active' AS status, CAST(NULL AS VARCHAR) AS expires_at FROM checkpoints WHERE id % 40 = 0 UNION ALL SELECT concat('to-', CAST(id + 1000000000 AS VARCHAR)), NULL, NULL, 'rejected', NULL FROM checkpoints WHERE id % 1000 = 0")
def p03_handoff(spark, d):
    rows = _stored(spark, d)
    asked = rows.filter("id % 40 = 0").select("tenant_id", F.col("id").alias("checkpoint_id")).unionByName(rows.filter("id % 1000 = 0").select("tenant_id", (F.col("id") + 1000000000).alias("checkpoint_id"))).withColumn("to_agent_id", F.concat(F.lit("to-"), F.col("checkpoint_id").cast("string")))
    made, rejected = checkpoints.handoff(rows, asked, _at())
    none = F.lit(None).cast("string")
    return made.select("agent_id", "from_agent_id", "checkpoint_data", "status", F.col("expires_at").cast("string").alias("expires_at")).unionByName(rejected.select(F.col("to_agent_id").alias("agent_id"), none.alias("from_agent_id"), none.alias("checkpoint_data"), F.lit("rejected").alias("status"), none.alias("expires_at")))


@query(f"{cte('checkpoints')} SELECT id AS checkpoint_id, concat('fact ', CAST(id AS VARCHAR)) AS claim, CAST(0.5 AS DOUBLE) AS confidence FROM checkpoints WHERE id % 2 = 0")
def p04_explode_facts(spark, d):
    fact = F.struct(F.concat(F.lit("fact "), F.col("id").cast("string")).alias("claim"), F.lit(0.5).alias("confidence"))
    rows = adapted(spark, d, "checkpoints").withColumn("checkpoint_data", F.to_json(F.struct(F.lit(3).alias("execution_version"), F.when(F.col("id") % 2 == 0, F.array(fact)).alias("discovered_facts"))))
    return checkpoints.explode_facts(rows).select("checkpoint_id", "claim", "confidence")


@query(f"{cte('checkpoints')} SELECT id, 0 AS pos, 'plan' AS step, concat(task_id, '.txt') AS file FROM checkpoints UNION ALL SELECT id, 1, 'do', concat(agent_id, '.txt') FROM checkpoints")
def p04_explode_steps_and_files(spark, d):
    payload = F.struct(F.array(F.lit("plan"), F.lit("do")).alias("pending_steps"), F.array(F.concat("task_id", F.lit(".txt")), F.concat("agent_id", F.lit(".txt"))).alias("files_touched"))
    rows = adapted(spark, d, "checkpoints").withColumn("checkpoint_data", F.to_json(payload))
    return checkpoints.explode_steps(rows).join(checkpoints.explode_files(rows), ["tenant_id", "id", "pos"]).select("id", "pos", "step", "file")


# --- Telemetry -----------------------------------------------------------------------------------------------------

_HOUR = "date_trunc('hour', ts)"
_USAGE_SQL = cte("usage") + f", u AS (SELECT *, {_HOUR} AS w FROM usage)"


def _usage(spark, d):
    return telemetry.windowed(adapted(spark, d, "usage"), "1 hour")


def _tally(kinds: tuple[str, ...]) -> str:
    return ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in kinds)


@query(_USAGE_SQL + f" SELECT {sql_text('w')} AS window_start, tenant_id, {_tally(telemetry.DECISION_KINDS)} FROM u GROUP BY w, tenant_id")
def a01_decision_metrics(spark, d):
    return text_of(telemetry.decision_metrics(_usage(spark, d), ["window_start", "tenant_id"]), "window_start")


@query(_USAGE_SQL + f" SELECT {sql_text('w')} AS window_start, tenant_id, {_tally(telemetry.CONTRADICTION_KINDS)} FROM u GROUP BY w, tenant_id")
def a02_contradiction_metrics(spark, d):
    return text_of(telemetry.contradiction_metrics(_usage(spark, d), ["window_start", "tenant_id"]), "window_start")


@query(_USAGE_SQL + f""", f AS (SELECT w, name, count(*) AS n FROM u WHERE kind = 'feature' GROUP BY ALL) SELECT {sql_text('w')} AS window_start, concat('{{', string_agg(concat('"', name, '":', CAST(n AS VARCHAR)), ',' ORDER BY name), '}}') AS features FROM f GROUP BY w""")
def a03_feature_usage(spark, d):
    out = telemetry.feature_usage(_usage(spark, d).filter("kind = 'feature'"), ["window_start"])
    return text_of(out.withColumn("features", F.to_json("features")), "window_start")


@query(_USAGE_SQL + f" SELECT {sql_text('w')} AS window_start, name AS error_type, count(*) AS n FROM u WHERE kind = 'error' GROUP BY w, name")
def a04_error_entries(spark, d):
    return text_of(telemetry.error_entries(_usage(spark, d).filter("kind = 'error'"), ["window_start"]), "window_start")


_PLACED = "SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY {1}) - 1 AS place, count(*) OVER (PARTITION BY {0}) AS n FROM {2} WHERE {1} IS NOT NULL"
_PICKS = ", ".join(f"min(CASE WHEN place = least(CAST(floor(n * CAST({p} AS DOUBLE)) AS BIGINT), n - 1) THEN {{0}} END) AS {name}" for name, p in telemetry.QUANTILES)


@query(f"WITH r AS ({_PLACED.format('event_type', 'value', 'events')}) SELECT event_type, max(n) AS n, {_PICKS.format('value')} FROM r GROUP BY event_type")
def a05_latency_percentiles(spark, d):
    return telemetry.latency_percentiles(table(spark, d, "events"), ["event_type"], "value")


@query(f"SELECT max(n) AS n, {_PICKS.format('value')} FROM (SELECT *, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)")
def a05_latency_percentiles_all(spark, d):
    return telemetry.latency_percentiles(table(spark, d, "events"), [], "value")


@query(f"SELECT {sql_text('date_trunc(\'day\', ts)')} AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, true AS p50_near, true AS p95_near, true AS p99_near FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def a05_merged_sketches(spark, d):
    """Days out of half-minute sketches: the ranks that each percentile's value takes among the day's events reach the asked one within the sketch's error and one event."""
    events = table(spark, d, "events").filter("value IS NOT NULL")
    by = ["window_start", "event_type"]
    days = telemetry.merged_percentiles(telemetry.latency_sketches(events, "30 seconds", ["event_type"], "value"), "1 day", ["event_type"])
    joined = telemetry.windowed(events, "1 day").join(days, by)
    counts = [c for name, _ in telemetry.QUANTILES for c in (F.count_if(F.col("value") < F.col(name)).alias(f"{name}_under"), F.count_if(F.col("value") <= F.col(name)).alias(f"{name}_upto"))]
    ranks = joined.groupBy(*by).agg(F.max("n").alias("n"), *counts)
    room = telemetry.SKETCH_ERROR + 1 / F.col("n")
    near = [((F.col(f"{name}_under") / F.col("n") <= p + room) & (F.col(f"{name}_upto") / F.col("n") >= p - room)).alias(f"{name}_near") for name, p in telemetry.QUANTILES]
    return text_of(ranks.select(*by, "n", *near), "window_start")


@query(_USAGE_SQL + f" SELECT {sql_text('w')} AS window_start, CAST(sum(tokens) AS BIGINT) AS tokens_saved, round(CAST(sum(tokens) AS BIGINT) * CAST(0.000002 AS DOUBLE), 9) AS estimated_cost, arg_max(model, struct_pack(a := ts, b := event_id)) AS last_model FROM u GROUP BY w")
def a06_cost_savings(spark, d):
    return text_of(telemetry.cost_savings(_usage(spark, d), ["window_start"], order=["ts", "event_id"]), "window_start")


@query(_EPOCHS_SQL.replace("WITH ", cte("decisions") + ", ", 1) + f""", k AS (SELECT tenant_id, count(*) AS active, count(*) FILTER (id % 9 = 0) AS quarantined FROM decisions WHERE {_ACTIVE} GROUP BY tenant_id),
l AS (SELECT tenant_id, arg_max(snapshot_hash, epoch_unix) AS snapshot_hash, arg_max(block_height, epoch_unix) AS block_height, arg_max(parent_snapshot_hash, epoch_unix) AS parent_snapshot_hash FROM snapshots GROUP BY tenant_id)
SELECT * FROM k LEFT JOIN l USING (tenant_id)""")
def a09_kpis(spark, d):
    rows = adapted(spark, d, "decisions").withColumn("status", F.when(F.col("id") % 9 == 0, "quarantined").otherwise(F.col("status")))
    return telemetry.kpis(rows, _snapshots(spark, d), _at())


@query(f"""{cte('decisions')}, a AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY valid_from, id) AS n FROM decisions WHERE {_ACTIVE} AND status IN ('canonical', 'approved'))
SELECT tenant_id, concat('{telemetry.HEADER}', string_agg(concat(CAST(n AS VARCHAR), '. [', scope_domain, '/', scope_system, '] ', title, ' (ID: ', CAST(id AS VARCHAR), ')', chr(10)), '' ORDER BY n), '{telemetry.FOOTER}') AS digest, count(*) AS n FROM a GROUP BY tenant_id""")
def a10_policy_digest(spark, d):
    return telemetry.policy_digest(adapted(spark, d, "decisions"), _at())


_DAY_USAGE_SQL = cte("usage") + ", u AS (SELECT *, date_trunc('day', ts) AS w FROM usage)"


@query(_DAY_USAGE_SQL + f""", m AS (SELECT w, tenant_id, {_tally(telemetry.DECISION_KINDS)}, {_tally(telemetry.CONTRADICTION_KINDS)}, CAST(sum(tokens) AS BIGINT) AS tokens_saved, round(CAST(sum(tokens) AS BIGINT) * CAST(0.000002 AS DOUBLE), 9) AS estimated_cost, arg_max(model, ts) AS last_model FROM u GROUP BY w, tenant_id),
f AS (SELECT w, tenant_id, concat('{{', string_agg(concat('"', name, '":', CAST(n AS VARCHAR)), ',' ORDER BY name), '}}') AS features FROM (SELECT w, tenant_id, name, count(*) AS n FROM u WHERE kind = 'feature' GROUP BY ALL) GROUP BY ALL),
e AS (SELECT w, tenant_id, concat('[', string_agg(concat('{{"error_type":"', name, '","n":', CAST(n AS VARCHAR), '}}'), ',' ORDER BY name), ']') AS errors FROM (SELECT w, tenant_id, name, count(*) AS n FROM u WHERE kind = 'error' GROUP BY ALL) GROUP BY ALL),
p AS (SELECT w, tenant_id, {_PICKS.format('latency_us')} FROM ({_PLACED.format('w, tenant_id', 'latency_us', 'u')}) GROUP BY w, tenant_id)
SELECT {sql_text('w')} AS window_start, base64(from_hex(substr(sha256(concat(tenant_id, 'pepper')), 1, 16))) AS tenant_hash, m.* EXCLUDE (w, tenant_id), features, errors, p50 / 1000.0 AS p50_ms, p95 / 1000.0 AS p95_ms, p99 / 1000.0 AS p99_ms
FROM m LEFT JOIN f USING (w, tenant_id) LEFT JOIN e USING (w, tenant_id) LEFT JOIN p USING (w, tenant_id)""".replace("p50 / 1000.0", "CAST(p50 AS DOUBLE) / CAST(1000 AS DOUBLE)").replace("p95 / 1000.0", "CAST(p95 AS DOUBLE) / CAST(1000 AS DOUBLE)").replace("p99 / 1000.0", "CAST(p99 AS DOUBLE) / CAST(1000 AS DOUBLE)"))
def a13_telemetry_payload(spark, d):
    return text_of(telemetry.telemetry_payload(adapted(spark, d, "usage"), "1 day", "pepper"), "window_start")


@query(_USAGE_SQL + f", m AS (SELECT w, tenant_id, {_tally(('proposed', 'detected'))} FROM u GROUP BY w, tenant_id) SELECT {sql_text('w')} AS window_start, tenant_id, CAST(sum(proposed) OVER x AS BIGINT) AS total_proposed, CAST(sum(detected) OVER x AS BIGINT) AS total_detected FROM m WINDOW x AS (PARTITION BY tenant_id ORDER BY w ROWS UNBOUNDED PRECEDING)")
def w12_cumulative(spark, d):
    by = ["window_start", "tenant_id"]
    metrics = telemetry.decision_metrics(_usage(spark, d), by).join(telemetry.contradiction_metrics(_usage(spark, d), by), by)
    return text_of(telemetry.cumulative(metrics, ["tenant_id"], "window_start", ["proposed", "detected"]), "window_start").select(*by, "total_proposed", "total_detected")


# --- Scalars -------------------------------------------------------------------------------------------------------


@query(f"""{cte('decisions')}, j AS (SELECT id, concat('{{"evidence_ids":"","id":"', CAST(id AS VARCHAR), '","owner":"', owner, '","scope_domain":"', scope_domain, '","scope_system":"', scope_system, '","status":"', status, '","title":"', title, ' \\u003c\\u0026\\u003e"}}') AS body FROM decisions)
SELECT id, sha256(body) AS leaf, sha256(concat('{X.GENESIS}', sha256(body))) AS root FROM j""")
def x01_x02_x03_leaf_hash(spark, d):
    rows = adapted(spark, d, "decisions")
    leaf = X.leaf_hash(F.col("id"), F.concat("title", F.lit(" <&>")), F.col("status"), F.col("scope_domain"), F.col("scope_system"), F.col("owner"))
    return rows.select("id", leaf.alias("leaf"), X.chain_hash(F.lit(X.GENESIS), leaf).alias("root"))


@query(f"{cte('writes')} SELECT id, {_UUID_SQL.format('tenant_id')} AS tenant_uuid, CASE WHEN id % 10 = 0 THEN 'anonymous' ELSE base64(from_hex(substr(sha256(concat(tenant_id, 'salt')), 1, 16))) END AS anonymous_id, lower(hex(encode(event_type))) AS evidence_hex, sha256(concat(tenant_id, '|', event_type, '|', CAST(id AS VARCHAR), '||5')) AS snapshot FROM writes")
def x04_x05_x06_x07_hashes(spark, d):
    rows = adapted(spark, d, "writes")
    who = F.when(F.col("id") % 10 == 0, "").otherwise(F.col("tenant_id"))
    return rows.select("id", X.uuid_v5(F.col("tenant_id")).alias("tenant_uuid"), X.anonymize(who, "salt").alias("anonymous_id"), X.evidence_hex(F.encode("event_type", "UTF-8")).alias("evidence_hex"), X.snapshot_hash(F.col("tenant_id"), F.col("event_type"), F.col("id"), F.lit(""), F.lit(5)).alias("snapshot"))


_OPS = ["propose_decision", "mcp_propose_decision", "query", "get_lineage", "mcp_checkpoint_save", "checkpoint_restore", "handoff", "other"]
_DOTTED = ["mcp.x.propose_decision", "api.query", "mcp.x.detect_contradictions", "agent.checkpoint", "other", "mcp.other.query", "agent.x.checkpoint", "api.x.propose_decision", "mcp.x.query"]


@query(f"""{cte('decisions')}, o AS (SELECT *, {_OPS}[CAST(id % {len(_OPS)} + 1 AS INTEGER)] AS op, {_DOTTED}[CAST(id % {len(_DOTTED)} + 1 AS INTEGER)] AS dotted, concat('{{"title":"', title, '","query":"', scope_domain, '"}}') AS payload FROM decisions)
SELECT id, CAST(CASE WHEN op LIKE '%propose_decision' THEN 100 + strlen(title) // 4 WHEN op = 'query' THEN 50 + strlen(scope_domain) // 4 WHEN op = 'get_lineage' THEN 30 WHEN op = 'mcp_checkpoint_save' THEN 50 WHEN op = 'checkpoint_restore' THEN 20 WHEN op = 'handoff' THEN 40 ELSE 100 END AS BIGINT) AS estimate,
       CAST(200 + CASE dotted WHEN 'mcp.x.propose_decision' THEN 500 WHEN 'api.query' THEN 300 WHEN 'mcp.x.query' THEN 300 WHEN 'mcp.x.detect_contradictions' THEN 800 WHEN 'agent.checkpoint' THEN 400 ELSE 0 END + ceil(strlen(payload) / 4.0) AS BIGINT) AS conservative FROM o""")
def x08_x09_x10_estimates(spark, d):
    rows = adapted(spark, d, "decisions")
    payload = F.to_json(F.struct("title", F.col("scope_domain").alias("query")))

    def pick(values: list[str]) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values) + 1).cast("int"))

    return rows.select("id", X.estimate_tokens(pick(_OPS), payload).alias("estimate"), X.estimate_tokens_conservative(pick(_DOTTED), payload, "x").alias("conservative"))


@query(f"""{cte('writes')} SELECT id, json_extract_string(props, '$.k') AS k, CAST(floor(epoch(ts)) AS BIGINT) AS unix, CAST(id AS DOUBLE) / CAST(1000 AS DOUBLE) AS ms, CASE WHEN id % 2 = 0 THEN 'canonical' ELSE 'draft' END AS status, contains(lower(event_type), 'click') AS is_click, trim(concat(' ', event_type, ' ')) AS kind FROM writes""")
def x11_x15_x17_x18_x19_misc(spark, d):
    rows = adapted(spark, d, "writes")
    status = X.parse_status(F.when(F.col("id") % 2 == 0, " Canonical ").otherwise("no such"))
    return rows.select("id", X.json_text(F.col("props"), "k").alias("k"), F.floor(F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")) / 1000000).alias("unix"), X.us_to_ms(F.col("id")).alias("ms"), status.alias("status"), F.lower("event_type").contains("click").alias("is_click"), F.trim(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("kind"))


@query(f"{cte('decisions')} SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE strftime(created_at, '%Y-%m-%d') END AS day FROM decisions")
def x16_parse_rfc3339(spark, d):
    text = F.when(F.col("id") % 5 == 0, "not a time").otherwise(F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return adapted(spark, d, "decisions").select("id", F.date_format(F.to_utc_timestamp(F.from_utc_timestamp(X.parse_rfc3339(text), F.current_timezone()), F.current_timezone()), "yyyy-MM-dd").alias("day"))


# --- Data quality --------------------------------------------------------------------------------------------------


@query(f"{cte('decisions')} SELECT id FROM decisions WHERE id % 13 = 0 AND valid_to IS NOT NULL AND valid_to > valid_from")
def q01_check_ranges(spark, d):
    rows = adapted(spark, d, "decisions")
    swapped = rows.withColumns({"valid_from": F.when((F.col("id") % 13 == 0) & F.col("valid_to").isNotNull(), F.col("valid_to")).otherwise(F.col("valid_from")), "valid_to": F.when((F.col("id") % 13 == 0) & F.col("valid_to").isNotNull(), F.col("valid_from")).otherwise(F.col("valid_to"))})
    return quality.check_ranges(swapped).select("id")


@query(f"{cte('decisions')} SELECT id, 'status' AS column FROM decisions WHERE status = 'approved' UNION ALL SELECT id, 'scope_system' FROM decisions WHERE scope_system = ''".replace("AS column", 'AS "column"'))
def q02_check_domains(spark, d):
    return quality.check_domains(adapted(spark, d, "decisions"), {"status": ["draft", "canonical"], "scope_system": ["db", "api"]}).select("id", "column")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def q03_check_orphans(spark, d):
    return quality.check_orphans(table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size > 5"), ["l_partkey"], ["p_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q04_check_unique(spark, d):
    return quality.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""{cte('decisions')}, c AS (SELECT 'valid_to' AS c, count(*) FILTER (valid_to IS NULL) AS n FROM decisions UNION ALL SELECT 'parent_id', count(*) FILTER (parent_id IS NULL) FROM decisions UNION ALL SELECT 'title', count(*) FILTER (title IS NULL) FROM decisions) SELECT c AS "column", n FROM c WHERE n > 0""")
def q05_check_not_null(spark, d):
    return quality.check_not_null(adapted(spark, d, "decisions"), ["valid_to", "parent_id", "title"])


def _lines_and_parts(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, d, "part").filter("p_size > 5")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def q06_cascade(spark, d):
    return quality.cascade(*_lines_and_parts(spark, d), ["l_partkey"], ["p_partkey"])


@query("SELECT l_orderkey, l_linenumber, p.p_partkey AS l_partkey FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) p ON p.p_partkey = l_partkey")
def q06_set_null(spark, d):
    return quality.cascade(*_lines_and_parts(spark, d), ["l_partkey"], ["p_partkey"], "set_null")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: per tenant what is in force, what is quarantined, and the state of its chain."""
    return a09_kpis(spark, sf_dir)
