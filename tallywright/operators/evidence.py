"""Content-addressed evidence and its reference counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import insert_ignore


def hashed(docs: DataFrame, content: str = "content") -> DataFrame:
    return docs.withColumn("block_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))


def ingest_evidence(target: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds documents (tenant_id, content, created_at) under their hash; the first stays, with one reference."""
    fresh = hashed(docs).withColumn("ref_count", F.lit(1)).select("tenant_id", "block_hash", "content", "ref_count", "created_at")
    return insert_ignore(target.select(*fresh.columns), fresh, ["tenant_id", "block_hash"], ["created_at", "content"])


def upsert_blocks(blocks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Reference counts of equal hashes add up (A07). Partial sums before the shuffle."""
    both = blocks.unionByName(incoming)
    return both.groupBy("block_hash").agg(F.min_by("content", "created_at").alias("content"), F.sum("ref_count").cast("long").alias("ref_count"), F.min("created_at").alias("created_at"))


def valid_changes(changes: DataFrame) -> DataFrame:
    """hash, delta and reject_reason: a change needs a hash of 64 hex digits and a whole number."""
    delta = F.expr("try_cast(delta AS bigint)")
    bad = F.when(~F.coalesce(F.lower("hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad_hash").when(delta.isNull(), "bad_delta")
    return changes.select(F.lower("hash").alias("hash"), delta.alias("delta"), bad.alias("reject_reason"))


def net_deltas(changes: DataFrame) -> DataFrame:
    """The sum of each hash's good changes, zeros dropped."""
    return valid_changes(changes).filter("reject_reason IS NULL").groupBy("hash").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def apply_deltas(evidence: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts after the deltas; unknown hashes change nothing."""
    return evidence.join(deltas.select(F.col("hash").alias("block_hash"), F.col("delta").alias("_d")), "block_hash", "left").withColumn("ref_count", (F.col("ref_count") + F.coalesce("_d", F.lit(0))).cast("long")).select(*evidence.columns)


def dedupe_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.dropDuplicates(["tenant_id", "snapshot_hash"])
