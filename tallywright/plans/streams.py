"""The streaming operators as queries: each reads a given table as a stream over what is available and returns its output.

Streams give what their batch counterparts give, in whatever order rows arrive, so most share their SQL. Jobs in
event-time order, and those that keep a table, read theirs dealt anew over several micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import fresh_path
from ..sources.tables import read_ref_changes
from ..streaming import jobs
from . import queries as batch
from .adapters import SELECTS, adapted, cte, sql_text, table, text_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table as a stream of its files. A table of one file is a filter on its folder: streams list folders."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _adapted_stream(spark: SparkSession, d: str, name: str, base: str) -> DataFrame:
    """An adapter of one table over that table as a stream."""
    return spark.sql(SELECTS[name], **{base: _source(spark, d, base)})


def _places(spark: SparkSession, name: str) -> tuple[str, str]:
    return fresh_path(spark, f"{name}-out"), fresh_path(spark, f"{name}-log")


#: Micro-batches over which a table is dealt anew.
BATCHES = 3


def _dealt(spark: SparkSession, rows: DataFrame, time: str | None = None) -> DataFrame:
    """The rows as a stream of about BATCHES micro-batches that follow no order. With ``time`` a last one has a far later row, so that the watermark passes all others."""
    path, files = fresh_path(spark, "dealt"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(BATCHES))
    for k in range(BATCHES):
        rows.filter(part == k).repartition(files).write.parquet(f"{path}/{k}")
    if time:
        at = F.expr(f"CAST('2900-01-01 00:00:00' AS {rows.schema[time].dataType.simpleString()})")
        spark.range(1).select(*[(at if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]).write.parquet(f"{path}/{BATCHES}")
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(path)


#: Wider than the time that the given tables span: nothing is late.
DELAY = "20000 days"


def _writes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    rows = events.select(F.col("user_id").cast("string").alias("tenant_id"), F.col("event_id").alias("id"), "ts", "event_type")
    return rows.withColumn("leaf_hash", F.sha2(F.concat_ws("|", F.col("id").cast("string"), "event_type"), 256))


@_register(batch._DELTA_SQL + " SELECT hash, delta FROM net")
def r01_s03_stream_ref_counts(spark, d):
    """A written log of changes, scanned as a stream; the last sum brings the batches' nets together."""
    path = fresh_path(spark, "changes")
    _changes(spark, d).withColumn("ts", F.lit(None).cast("timestamp")).write.parquet(path)
    out, log = _places(spark, "refs")
    nets = jobs.finished(jobs.stream_ref_counts(read_ref_changes(spark, path), out, log), spark, out)
    return nets.groupBy("hash").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("doc_id") % 17 == 0, "x").when(F.col("doc_id") % 3 == 0, "-1").otherwise("1")
    return table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), delta.alias("delta"))


def _applied(spark: SparkSession, d: str) -> tuple[str, str]:
    """Places of a table of ten references for each text, after the stream of changes, and of the changes it rejected."""
    counts, rejects = fresh_path(spark, "counts"), fresh_path(spark, "rejects")
    jobs.write_ref_table(_changes(spark, d).select(F.col("hash").alias("block_hash")).distinct().withColumn("ref_count", F.lit(10)), counts)
    query = jobs.stream_apply_refs(_dealt(spark, _changes(spark, d)), counts, rejects, fresh_path(spark, "applied-log"))
    jobs.finished(query, spark, counts)
    return counts, rejects


@_register(batch.ORACLES["j08_apply_deltas"])
def r01_stream_apply_refs(spark, d):
    """Counts in their table, bucket by bucket, after several micro-batches of changes."""
    return spark.read.parquet(_applied(spark, d)[0]).select("block_hash", "ref_count")


@_register("SELECT sha256(coalesce(text, '')) AS hash, 'bad_delta' AS reject_reason, count(*) AS n FROM documents WHERE doc_id % 17 = 0 GROUP BY 1")
def r01_stream_rejects(spark, d):
    return spark.read.parquet(_applied(spark, d)[1]).groupBy("hash", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@_register(batch._HARVEST_SQL + "SELECT source_id, extracted_decision FROM h WHERE confidence >= 0.7")
def r02_stream_harvest(spark, d):
    """Each message comes twice, as in overlapping exports, and is taken once."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("channel_id"), F.concat(F.col("turn").cast("string"), F.lit(".000100")).alias("ts"), "text")
    twice = rows.withColumn("export", F.explode(F.array(F.lit(0), F.lit(1))))
    out, log = _places(spark, "harvest")
    return jobs.finished(jobs.stream_harvest(_dealt(spark, twice).drop("export"), out, log, batch.KEYWORDS), spark, out).select("source_id", "extracted_decision")


@_register("SELECT CAST(conv_id AS VARCHAR) AS channel_id, CAST(max(turn) AS DOUBLE) + 0.0001 AS mark FROM conversations GROUP BY conv_id")
def r02_high_water_marks(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("channel_id"), F.concat(F.col("turn").cast("string"), F.lit(".000100")).alias("ts"), "text")
    out, log = _places(spark, "harvest")
    jobs.finished(jobs.stream_harvest(_dealt(spark, rows), out, log, batch.KEYWORDS), spark, out)
    return jobs.high_water_marks(spark, out).select("channel_id", F.col("mark").cast("double").alias("mark"))


@_register(f"SELECT {sql_text('w')} AS window_start, event_type AS kind, count(*) AS n FROM (SELECT *, date_trunc('day', ts) AS w FROM events) WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events) GROUP BY w, event_type")
def r03_stream_telemetry(spark, d):
    """Windows that the watermark has closed; the last one stays open."""
    events = _source(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    out, log = _places(spark, "telemetry")
    rows = jobs.finished(jobs.stream_telemetry(events, out, log, "1 day"), spark, out)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "kind", "n")


@_register(batch._QUARANTINE_SQL + " SELECT tenant_id, id, status, conflicting_id FROM quarantined")
def r04_c09_stream_quarantine(spark, d):
    key = F.col("p_partkey")
    parts = table(spark, d, "part").select((F.col("p_size") % 3).cast("string").alias("tenant_id"), key.alias("id"), F.col("p_name").alias("title"), F.lit("draft").alias("status"), F.col("p_brand").alias("scope_domain"), F.col("p_type").alias("scope_system"), F.timestamp_seconds(key).alias("created_at"))
    out, log = _places(spark, "quarantine")
    rows = jobs.finished(jobs.stream_quarantine(_dealt(spark, parts, "created_at"), out, log, ["id"], batch.RULE, delay=DELAY), spark, out)
    return rows.select("tenant_id", "id", F.col("new_status").alias("status"), "conflicting_id")


def _chained(spark: SparkSession, d: str) -> str:
    out, log = _places(spark, "chain")
    jobs.finished(jobs.stream_chain(_dealt(spark, _writes(spark, d), "ts"), out, log, ["ts", "id"], delay=DELAY), spark, out)
    return out


@_register(batch._CHAIN_SQL + " SELECT tenant_id, id, height, root_hash FROM chain")
def r05_stream_chain(spark, d):
    return spark.read.parquet(_chained(spark, d)).select("tenant_id", "id", "height", "root_hash")


@_register(batch._METER_SQL + " SELECT request_id, allowed, CAST(remaining_tokens AS BIGINT) AS remaining_tokens, table_status FROM metered")
def r06_stream_meter(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("tenant_id"), F.col("event_id").alias("request_id"), "ts", F.ceil("value").cast("long").alias("tokens_used"), F.lit(1).cast("long").alias("executions_used"))
    out, log = _places(spark, "meter")
    done = jobs.finished(jobs.stream_meter(_dealt(spark, rows, "ts"), out, log, ["ts", "request_id"], batch.BALANCE, 60, delay=DELAY), spark, out)
    return done.select("request_id", "allowed", "remaining_tokens", "table_status")


@_register(batch._CHAIN_SQL + ", r AS (SELECT tenant_id, arg_max(root_hash, height) AS root_hash, max(height) AS block_height FROM chain GROUP BY tenant_id) SELECT tenant_id, block_height, '' AS parent_snapshot_hash, sha256(concat(tenant_id, '|', root_hash, '|', CAST(block_height AS VARCHAR), '||1735689600')) AS snapshot_hash FROM r")
def r07_stream_snapshots(spark, d):
    """All tenants of the chain's stream output at one tick of the snapshot job."""
    chained, (snaps, log) = _chained(spark, d), _places(spark, "snaps")
    ticks = _source(spark, d, "region")
    rows = jobs.finished(jobs.stream_snapshots(ticks, chained, snaps, log, "timestamp_seconds(1735689600)"), spark, snaps)
    return rows.select("tenant_id", "block_height", "parent_snapshot_hash", "snapshot_hash")


@_register(batch.ORACLES["a13_telemetry_payload"].replace("SELECT strftime(w", "SELECT CAST(floor((row_number() OVER (ORDER BY w, base64(from_hex(substr(sha256(concat(tenant_id, 'pepper')), 1, 16)))) - 1) / 100) AS BIGINT) AS upload, strftime(w", 1))
def r03_stream_payloads(spark, d):
    """One flush over what is there, in uploads of 100 payloads."""
    out, log = _places(spark, "payloads")
    rows = jobs.finished(jobs.stream_payloads(_adapted_stream(spark, d, "usage", "events"), out, log, "1 day", "pepper"), spark, out)
    return text_of(rows.drop("batch", *[c for c in rows.columns if c.startswith("total_")]), "window_start")


_KINDS = ("proposed", "reused", "rejected", "stale", "detected", "resolved", "false_positive")


@_register(
    cte("usage")
    + ", f AS (SELECT tenant_id, string_agg(name || '=' || n, ',' ORDER BY name) AS features FROM (SELECT tenant_id, name, count(*) AS n FROM usage WHERE kind = 'feature' GROUP BY ALL) GROUP BY tenant_id)"
    + " SELECT base64(from_hex(substr(sha256(concat(u.tenant_id, 'pepper')), 1, 16))) AS tenant_hash, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS total_{k}" for k in _KINDS)
    + ", CAST(sum(tokens) AS BIGINT) AS total_tokens_saved, any_value(f.features) AS features FROM usage u LEFT JOIN f USING (tenant_id) GROUP BY u.tenant_id"
)
def r03_stream_totals(spark, d):
    """What a tenant's payloads count in all after several flushes."""
    out, log = _places(spark, "payloads")
    rows = jobs.finished(jobs.stream_payloads(_dealt(spark, adapted(spark, d, "usage")), out, log, "1 day", "pepper"), spark, out)
    last = rows.groupBy("tenant_hash").agg(F.max_by(F.struct(*[c for c in rows.columns if c.startswith("total_")]), F.struct("batch", "window_start")).alias("t")).select("tenant_hash", "t.*")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("total_features")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return last.withColumn("features", listed).drop("total_features")


@_register(f"SELECT o_orderkey AS id, CASE WHEN o_orderdate < TIMESTAMP '{batch.AT}' THEN 'stale' ELSE o_orderstatus END AS status FROM orders")
def r08_stream_expire(spark, d):
    """Decisions arrive valid, in several micro-batches; the tick after their expiry turns them stale without their coming again."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("valid_to"), F.col("o_orderdate").alias("updated_at"))
    ticks = _source(spark, d, "region").select(F.expr(f"TIMESTAMP_NTZ '{batch.AT}'").alias("at"))
    out, log = _places(spark, "expire")
    changes = jobs.finished(jobs.stream_expire(_dealt(spark, rows), ticks, out, log), spark, out)
    return jobs.as_of_now(changes, ["id"]).select("id", "status")
