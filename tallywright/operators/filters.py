"""Projections, filters and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import present, small_join
from ..functions.scalars import clamp_limit, parse_status


def for_tenant(df: DataFrame, tenant: str) -> DataFrame:
    return df.filter(F.col("tenant_id") == tenant)


def by_scope(df: DataFrame, domain: str = "", system: str = "") -> DataFrame:
    """Empty means any: such filters are left out of the plan."""
    out = df.filter(F.col("scope_domain") == domain) if present(domain) else df
    return out.filter(F.col("scope_system") == system) if present(system) else out


def list_decisions(df: DataFrame, tenant: str | None = None, scope: dict[str, str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Up to four scope parts and a status list, newest first; without a tenant all tenants."""
    out = for_tenant(df, tenant) if present(tenant) else df
    for part, value in (scope or {}).items():
        if present(value):
            out = out.filter(F.col(f"scope.{part}") == value)
    out = out.filter(F.col("status").isin(statuses)) if present(statuses) else out
    return out.orderBy(F.desc("created_at"), "id")


def get(df: DataFrame, tenant: str, id: str) -> DataFrame:
    return df.filter((F.col("tenant_id") == tenant) & (F.col("id") == id))


def children_of(df: DataFrame, tenant: str, parent: str) -> DataFrame:
    return for_tenant(df, tenant).filter(F.col("parent_id") == parent).orderBy(F.desc("created_at"), "id")


def search_titles(df: DataFrame, tenant: str, query: str) -> DataFrame:
    """Titles that contain the words as they are, in any case (F06). ``n_found`` is the count of all."""
    found = for_tenant(df, tenant).filter(F.lower("title").contains(query.lower()))
    total = found.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_found"))  # one row: the tenant is fixed
    return found.join(F.broadcast(total), "tenant_id").select(*found.columns, "n_found")


def revisions(df: DataFrame, tenant: str, id: str) -> DataFrame:
    return for_tenant(df, tenant).filter(F.col("decision_id") == id).orderBy("revision_number")


def top_checkpoints(df: DataFrame, k: int) -> DataFrame:
    """The k newest checkpoints of every agent."""
    newest = Window.partitionBy("tenant_id", "agent_id").orderBy(F.desc("created_at"), "id")
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= k).drop("_rn")


def agent_checkpoints(df: DataFrame, tenant: str, agent: str, limit: int) -> DataFrame:
    active = for_tenant(df, tenant).filter((F.col("agent_id") == agent) & (F.col("status") == "active"))
    return active.orderBy(F.desc("created_at"), "id").limit(limit)


def list_harvested(df: DataFrame, source_type: str = "", validated_only: bool = False) -> DataFrame:
    out = df.filter(F.col("source_type") == source_type) if present(source_type) else df
    return (out.filter("human_validated") if validated_only else out).orderBy(F.desc("created_at"), "id")


def list_contradictions(df: DataFrame, tenant: str, resolved: bool) -> DataFrame:
    return for_tenant(df, tenant).filter(F.col("resolved") == resolved).orderBy(F.desc("created_at"), "id")


def unresolved(df: DataFrame, tenant: str) -> DataFrame:
    return for_tenant(df, tenant).filter(~F.col("resolved")).orderBy("created_at", "id")


def tenants(df: DataFrame) -> DataFrame:
    return df.select("tenant_id").distinct()


def _filled(c: str, default: Column) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), default)


def normalize_decisions(df: DataFrame, now: Column, owner: str = "agent-system", confidence: float | None = None) -> DataFrame:
    """Defaults on write, and flat and nested scope brought together."""
    domain = F.coalesce(F.nullif(F.col("scope_domain"), F.lit("")), F.col("scope.domain"), F.lit(""))
    system = F.coalesce(F.nullif(F.col("scope_system"), F.lit("")), F.col("scope.system"), F.lit(""))
    nested = F.struct(
        F.coalesce(F.nullif(F.col("scope.domain"), F.lit("")), domain).alias("domain"),
        F.coalesce(F.nullif(F.col("scope.system"), F.lit("")), system).alias("system"),
        F.col("scope.team").alias("team"),
        F.col("scope.env").alias("env"),
    )
    out = df.withColumns({"status": parse_status(_filled("status", F.lit("draft"))), "owner": _filled("owner", F.lit(owner)), "valid_from": F.coalesce("valid_from", now), "scope_domain": domain, "scope_system": system, "scope": nested})
    return out if confidence is None else out.withColumn("confidence", F.coalesce("confidence", F.lit(confidence)))


def blank_hashes(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def promotable(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter((F.col("confidence") >= threshold) & ~F.col("human_validated"))


def budgets_with_defaults(tenant_ids: DataFrame, budgets: DataFrame, tokens: int = 1_000_000, executions: int = 10_000) -> DataFrame:
    """Every tenant's budget; the default row where none is stored."""
    out = tenant_ids.select("tenant_id").distinct().join(budgets.select("tenant_id", "token_balance", "tokens_consumed", "execution_limit", "executions_consumed", "status"), "tenant_id", "left")
    defaults = {"token_balance": tokens, "tokens_consumed": 0, "execution_limit": executions, "executions_consumed": 0, "status": "active"}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(out.schema[c].dataType)) for c, v in defaults.items()})


def preflight(requests: DataFrame, budgets: DataFrame, estimate: str = "estimate") -> DataFrame:
    """Whether a request could run on the budget as it stands, and why not (F16). Missing budgets do not admit."""
    joined = small_join(requests, budgets.select("tenant_id", "token_balance", F.col("status").alias("_status")), ["tenant_id"], "left")
    reason = F.when(F.col("token_balance").isNull(), "no budget").when(F.col("_status") == "exhausted", "exhausted").when(F.col("token_balance") < F.col(estimate), F.concat(F.lit("need "), F.col(estimate).cast("string"), F.lit(", have "), F.col("token_balance").cast("string")))
    return joined.withColumn("reason", reason).withColumn("admitted", reason.isNull()).select(*requests.columns, "admitted", "reason")


def latest_snapshot(df: DataFrame) -> DataFrame:
    """Each tenant's last snapshot, partially aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in ("tenant_id", "epoch_timestamp")]
    return df.groupBy("tenant_id").agg(F.max_by(F.struct("epoch_timestamp", *rest), F.struct("epoch_timestamp", "block_height", "snapshot_hash")).alias("s")).select("tenant_id", "s.*")


def list_snapshots(df: DataFrame, tenant: str, limit: int | None = 10) -> DataFrame:
    return for_tenant(df, tenant).orderBy(F.desc("epoch_timestamp"), F.desc("block_height")).limit(clamp_limit(limit, 1, 100, 20))
