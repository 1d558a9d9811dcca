"""Scans and sinks of ledger tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import present
from ..schemas import BUDGET_REQUEST, CHECKPOINT_REQUEST, PROPOSAL, SCHEMAS


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A ledger table with its fixed schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).options(**options).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **properties) -> DataFrame:
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=partitions, properties=properties)


def messages_since(messages: DataFrame, since: str | None = None, channels: list[str] | None = None) -> DataFrame:
    """Messages from a time on; no channels given means all."""
    out = messages.filter(F.col("ts") >= F.lit(since)) if present(since) else messages
    return out.filter(F.col("channel_id").isin(channels)) if present(channels) else out


def read_messages(spark: SparkSession, path: str, since: str | None = None, channels: list[str] | None = None, fmt: str = "json") -> DataFrame:
    return messages_since(read_table(spark, "messages", path, fmt), since, channels)


def read_ref_changes(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """A stream of reference-count changes."""
    return spark.readStream.schema(SCHEMAS["ref_changes"]).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def _parsed(df: DataFrame, col: str, schema: str, problems: list[tuple[str, Column]]) -> DataFrame:
    decoded = df.withColumn("_p", F.from_json(col, schema))
    well = F.get_json_object(F.col(col), "$").isNotNull() & F.trim(F.col(col)).startswith("{")
    reject = F.when(~F.coalesce(well, F.lit(False)), F.lit("malformed_json"))
    for reason, bad in problems:
        reject = reject.when(bad, F.lit(reason))
    return decoded.withColumn("reject_reason", reject).select(*df.columns, "_p.*", "reject_reason") if not set(df.columns) & {f.split()[0] for f in schema.split(", ")} else decoded.withColumn("reject_reason", reject).select("_p.*", "reject_reason")


def _blank(field: str) -> Column:
    return F.coalesce(F.col(f"_p.{field}"), F.lit("")) == ""


def parse_proposals(df: DataFrame, col: str) -> DataFrame:
    """Decoded proposals; ``reject_reason`` is null where a row is good."""
    return _parsed(df, col, PROPOSAL, [("missing_title", _blank("title")), ("missing_tenant", _blank("tenant_id"))])


def parse_checkpoints(df: DataFrame, col: str) -> DataFrame:
    return _parsed(df, col, CHECKPOINT_REQUEST, [("missing_agent", _blank("agent_id"))])


def parse_budget_requests(df: DataFrame, col: str) -> DataFrame:
    """Decoded budget requests (S05); negative amounts are rejected."""
    negative = (F.coalesce(F.col("_p.tokens_used"), F.lit(0)) < 0) | (F.coalesce(F.col("_p.executions_used"), F.lit(0)) < 0)
    return _parsed(df, col, BUDGET_REQUEST, [("missing_agent", _blank("agent_id")), ("negative_amount", negative)])


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str], preserve: list[str] = ["created_at"]) -> DataFrame:  # noqa: B006
    """Last write wins by ``order``; the ``preserve`` columns keep their first value (S06, S10). One shuffle by key."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc(c) for c in order])
    whole = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rn", F.row_number().over(newest))
    for c in preserve:
        ranked = ranked.withColumn(c, F.min(c).over(whole))
    return ranked.filter("_rn = 1").select(*target.columns)


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Adds rows whose key is not there yet; of several new rows with a key the first by ``order``."""
    first = Window.partitionBy(*keys).orderBy(*(order or keys))
    fresh = new.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return target.unionByName(fresh.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append-only sink."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON text (S09). An envelope with count and items is for small results: see :func:`envelope`."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def envelope(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """count and items per group, ``items`` sorted; groups are pages of a result, bounded by the caller."""
    fields = [*order, *[c for c in df.columns if c not in order and c not in by]]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("items"))


def save_manifests(target: DataFrame, updates: DataFrame) -> DataFrame:
    return upsert(target, updates, ["task_id"], ["updated_at"])
