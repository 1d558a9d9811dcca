"""Validity intervals and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import present
from .filters import by_scope

DEFAULT_STATUSES = ["canonical", "approved", "draft"]


def _holds(at: Column) -> Column:
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))


def active_at(df: DataFrame, at: Column, domain: str = "", system: str = "", statuses: list[str] | None = None) -> DataFrame:
    """Rows valid at an instant, both ends included (B01). A narrow, pushed-down filter."""
    out = by_scope(df.filter(_holds(at)), domain, system)
    return out.filter(F.col("status").isin(statuses)) if present(statuses) else out


#: Instants up to this many are tested against each row; a few comparisons a row are cheaper than listing its days.
FEW_INSTANTS = 64


def active_at_each(instants: DataFrame, df: DataFrame, instant: str = "at", tenant: bool = False, long_days: int = 366) -> DataFrame:
    """Pairs of instants and the rows valid then.

    Intervals up to ``long_days`` are listed by day and joined on it, so the join is by equality; longer and open
    ones are listed by year from their first to the last year that an instant has. A handful of instants is
    broadcast and tested against each row. All ways give the same pairs. Null instants match nothing.
    """
    on_tenant = ["tenant_id"] if tenant else []
    match = _holds(F.col(instant))
    if instants.limit(FEW_INSTANTS + 1).count() <= FEW_INSTANTS:
        right = F.broadcast(instants.withColumnRenamed("tenant_id", "_t") if tenant else instants)
        return df.join(right, match & (F.col("tenant_id") == F.col("_t")) if tenant else match).drop("_t")
    last = instants.agg(F.max(instant)).first()[0]
    end = F.least(F.coalesce("valid_to", F.lit(last)), F.lit(last))
    rows = df.filter((F.col("valid_from") <= F.lit(last)) & (F.col("valid_from") <= end))
    short = F.datediff(end, "valid_from") <= long_days
    day = rows.filter(short).withColumn("_k", F.explode(F.sequence(F.to_date("valid_from"), F.to_date(end))))
    year = rows.filter(~short).withColumn("_k", F.explode(F.sequence(F.year("valid_from"), F.year(end))))
    by_day = day.join(instants.withColumn("_k", F.to_date(instant)), [*on_tenant, "_k"]).filter(match)
    by_year = year.join(instants.withColumn("_k", F.year(instant)), [*on_tenant, "_k"]).filter(match)
    return by_day.drop("_k").unionByName(by_year.drop("_k"))


def history(writes: DataFrame, tenant: str, id: str) -> DataFrame:
    """All versions of a decision in the write log."""
    return writes.filter((F.col("tenant_id") == tenant) & (F.col("id") == id)).orderBy("valid_from", "updated_at")


def as_recorded(writes: DataFrame, tx_time: Column, ties: list[str] | None = None) -> DataFrame:
    """The table as it stood at a transaction time: the last write of each key up to then; of those at one time the last by ``ties``."""
    rows = writes.filter(F.col("updated_at") <= tx_time)
    rest = [c for c in writes.columns if c not in ("tenant_id", "id")]
    last = rows.groupBy("tenant_id", "id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", *(ties or []))).alias("_last"))
    return last.select("tenant_id", "id", "_last.*").select(*writes.columns)


def expiry_of(df: DataFrame) -> Column:
    """expires_at, else the metadata's effective_to, else created_at and the time to live."""
    ttl = F.when(F.col("temporal_metadata.ttl_seconds") > 0, F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("temporal_metadata.ttl_seconds")))
    first = [F.col("expires_at")] if "expires_at" in df.columns else []
    return F.coalesce(*first, F.col("temporal_metadata.effective_to"), ttl)


def mark_expired(df: DataFrame, now: Column, expiry: Column | None = None) -> DataFrame:
    """Rows past their expiry become stale, unless executed or stale already."""
    due = (expiry_of(df) if expiry is None else expiry) < now
    hit = F.coalesce(due & ~F.col("status").isin("executed", "stale"), F.lit(False))
    return df.withColumns({"status": F.when(hit, "stale").otherwise(F.col("status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def backfill_validity(df: DataFrame) -> DataFrame:
    return df.withColumn("valid_from", F.coalesce("valid_from", "created_at"))


def with_expiry(df: DataFrame, ttl: str = "ttl_seconds") -> DataFrame:
    """expires_at = created_at + ttl where the ttl is positive, else null."""
    return df.withColumn("expires_at", F.when(F.col(ttl) > 0, F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(ttl))))
