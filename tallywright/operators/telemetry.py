"""Telemetry rollups by window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import running_sum
from ..functions.scalars import anonymize
from .filters import latest_snapshot
from .temporal import active_at

#: Cost per token; payloads of an upload; the counted kinds.
TOKEN_COST = 0.000002
DECISION_KINDS = ("proposed", "reused", "rejected", "stale")
UPLOAD_ROWS = 100
CONTRADICTION_KINDS = ("detected", "resolved", "false_positive")
QUANTILES = (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))


def windowed(events: DataFrame, every: str, ts: str = "ts") -> DataFrame:
    return events.withColumn("window_start", F.window(ts, every)["start"])


def _counts(events: DataFrame, by: list[str], kinds: tuple[str, ...], kind: str) -> DataFrame:
    return events.groupBy(*by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def decision_metrics(events: DataFrame, by: list[str], kind: str = "kind") -> DataFrame:
    return _counts(events, by, DECISION_KINDS, kind)


def contradiction_metrics(events: DataFrame, by: list[str], kind: str = "kind") -> DataFrame:
    return _counts(events, by, CONTRADICTION_KINDS, kind)


def feature_usage(events: DataFrame, by: list[str], feature: str = "name") -> DataFrame:
    """A map from feature to uses; features are few by nature."""
    return events.groupBy(*by, feature).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(feature), "_n")))).alias("features"))


def error_entries(events: DataFrame, by: list[str], error: str = "name") -> DataFrame:
    return events.groupBy(*by, F.col(error).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95, p99 as the value at place int(n * p), the last at most, from 0 (A05). Exact; nulls do not count.

    Distinct values are counted first; places are running sums over ranges of them, so no task sees a whole group.
    """
    counted = events.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_sum(counted, by, ["_v"], "_c", "_end")
    totals = placed.groupBy(*[F.col(c).alias(f"_b_{c}") for c in by]).agg(F.sum("_c").alias("_n"))
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by], F.lit(True))
    ranked = placed.join(totals, match)

    def at(p: float) -> Column:
        place = F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1)
        return F.min(F.when(F.col("_end") > place, F.col("_v")))

    return ranked.groupBy(*by).agg(F.max("_n").alias("n"), *[at(p).alias(name) for name, p in QUANTILES]).filter(F.col("n") > 0)


#: Size of a quantile sketch, and its error in rank (of 1) with a confidence of 99 percent, merged or not.
SKETCH_SIZE = 800
SKETCH_ERROR = 0.005


def latency_sketches(events: DataFrame, every: str, by: list[str], value: str, ts: str = "ts", size: int = SKETCH_SIZE) -> DataFrame:
    """window_start, by, n, sketch: partial aggregates to be stored, a few kilobytes a window and group (A05 where exactness may give way)."""
    rows = windowed(events.filter(F.col(value).isNotNull()), every, ts)
    return rows.groupBy("window_start", *by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merged_percentiles(sketches: DataFrame, every: str, by: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """n, p50, p95, p99 of longer windows out of stored sketches of shorter ones; no event is read again. Ranks are within SKETCH_ERROR."""
    rows = sketches.withColumn("_w", F.window("window_start", every)["start"])
    merged = rows.groupBy(F.col("_w").alias("window_start"), *by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("_s"))
    return merged.select("window_start", *by, "n", *[F.kll_sketch_get_quantile_double(F.col("_s"), F.lit(p)).alias(name) for name, p in QUANTILES])


def cost_savings(events: DataFrame, by: list[str], tokens: str = "tokens", model: str = "model", order: list[str] = ["ts"]) -> DataFrame:  # noqa: B006
    """Tokens saved, their cost, and the last model seen."""
    return events.groupBy(*by).agg(F.sum(tokens).alias("tokens_saved"), F.round(F.sum(tokens) * F.lit(TOKEN_COST), 9).alias("estimated_cost"), F.max_by(model, F.struct(*order)).alias("last_model"))


def cumulative(metrics: DataFrame, keys: list[str], window: str, counters: list[str]) -> DataFrame:
    """Counters summed over all windows so far, per key."""
    so_far = Window.partitionBy(*keys).orderBy(window).rowsBetween(Window.unboundedPreceding, 0)
    return metrics.withColumns({f"total_{c}": F.sum(c).over(so_far) for c in counters})


def telemetry_payload(events: DataFrame, every: str, salt: str = "") -> DataFrame:
    """One row per window and tenant with all metrics (A13). Tenants are anonymised. ``events`` has ts, tenant_id, kind, name, latency_us, tokens, model."""
    by = ["window_start", "tenant_id"]
    rows = windowed(events, every)
    parts = [
        decision_metrics(rows, by),
        contradiction_metrics(rows, by),
        feature_usage(rows.filter("kind = 'feature'"), by).withColumn("features", F.to_json("features")),
        error_entries(rows.filter("kind = 'error'"), by).groupBy(*by).agg(F.to_json(F.sort_array(F.collect_list(F.struct("error_type", "n")))).alias("errors")),
        latency_percentiles(rows, by, "latency_us").select(*by, *[(F.col(n) / 1000.0).alias(f"{n}_ms") for n, _ in QUANTILES]),
        cost_savings(rows, by),
    ]
    out = reduce(lambda a, b: a.join(b, by, "left"), parts)
    zero = {f"{n}_ms": F.coalesce(f"{n}_ms", F.lit(0.0)) for n, _ in QUANTILES}
    return out.withColumns(zero).withColumn("tenant_hash", anonymize(F.col("tenant_id"), salt)).drop("tenant_id")


def uploads(payloads: DataFrame, size: int = UPLOAD_ROWS) -> DataFrame:
    """payloads with ``upload``: which batch of at most ``size`` rows each belongs to, in the order of windows and tenants."""
    return running_sum(payloads.withColumn("_one", F.lit(1)), [], ["window_start", "tenant_hash"], "_one", "_n").withColumn("upload", F.floor((F.col("_n") - 1) / size)).drop("_one", "_n")


_TOTALLED = (*DECISION_KINDS, *CONTRADICTION_KINDS, "tokens_saved")
_FEATURES = "map<string,bigint>"


def _added(a: Column, b: Column) -> Column:
    """The sums of two maps of counts."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0).cast("long")) + F.coalesce(y, F.lit(0).cast("long")))


def with_totals(payloads: DataFrame, past: DataFrame | None) -> DataFrame:
    """payloads of a flush with total_<counter> and total_features: sums over a tenant's windows so far and the flushes before.

    ``past`` is what :func:`totals_after` gave after the flush before. A flush has few windows of a tenant.
    """
    none = F.create_map().cast(_FEATURES)
    known = payloads.select("tenant_hash").distinct()
    if past is None:
        start = known.select("tenant_hash", *[F.lit(0).cast("long").alias(f"_{c}") for c in _TOTALLED], none.alias("_features"))
    else:
        old = past.select("tenant_hash", *[F.col(f"total_{c}").alias(f"_{c}") for c in _TOTALLED], F.col("total_features").alias("_features"))
        start = known.join(old, "tenant_hash", "left").select("tenant_hash", *[F.coalesce(f"_{c}", F.lit(0).cast("long")).alias(f"_{c}") for c in _TOTALLED], F.coalesce("_features", none).alias("_features"))
    so_far = Window.partitionBy("tenant_hash").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.from_json("features", _FEATURES), none)
    rows = payloads.join(start, "tenant_hash").withColumn("_maps", F.collect_list(own).over(so_far))
    totals = {f"total_{c}": F.col(f"_{c}") + F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).over(so_far) for c in _TOTALLED}
    rows = rows.withColumns(totals).withColumn("total_features", F.aggregate("_maps", F.col("_features"), _added))
    return rows.select(*payloads.columns, *totals, "total_features")


def totals_after(flush: DataFrame, past: DataFrame | None) -> DataFrame:
    """A row a tenant: its totals after a flush that has gone through :func:`with_totals`."""
    names = [*[f"total_{c}" for c in _TOTALLED], "total_features"]
    now = flush.groupBy("tenant_hash").agg(F.max_by(F.struct(*names), "window_start").alias("t")).select("tenant_hash", "t.*")
    return now if past is None else now.unionByName(past.join(now.select("tenant_hash"), "tenant_hash", "left_anti").select(*now.columns))


def kpis(decisions: DataFrame, snapshots: DataFrame, at: Column) -> DataFrame:
    """Per tenant: active decisions, quarantined among them, and the latest snapshot."""
    counts = active_at(decisions, at).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("status") == "quarantined").alias("quarantined"))
    last = latest_snapshot(snapshots).select("tenant_id", "snapshot_hash", "block_height", "parent_snapshot_hash")
    return counts.join(last, "tenant_id", "left")


#: Fixed value: the format of a numbered policy line.
POLICY_LINE = "%d. [%s/%s] %s (ID: %s)\n"
HEADER = "--- ACTIVE POLICIES ---\nThese decisions are in force:\n\n"
FOOTER = "\nPlans and code must agree with them.\n-----------------------\n"


def policy_digest(decisions: DataFrame, at: Column) -> DataFrame:
    """Per tenant the numbered lines of its active canonical and approved decisions (A10). A tenant's text holds all its policies."""
    active = active_at(decisions, at, statuses=["canonical", "approved"])
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy("valid_from", "id"))
    line = F.format_string(POLICY_LINE, F.col("_n"), F.coalesce("scope_domain", F.lit("")), F.coalesce("scope_system", F.lit("")), F.coalesce("title", F.lit("")), F.col("id").cast("string"))
    lines = active.withColumn("_n", place).withColumn("_line", line)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "")
    return lines.groupBy("tenant_id").agg(F.concat(F.lit(HEADER), text, F.lit(FOOTER)).alias("digest"), F.count(F.lit(1)).alias("n"))
