"""Streaming counterparts (R01-R08). Each reuses its batch operator.

Stateful jobs advance in strict event-time order (see :mod:`.ordered`): rows wait for the watermark, late ones go to
a side output at <out>-late. Every job takes a checkpoint location and writes Parquet; batches are idempotent by batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..common import saved, small_join, written
from ..functions.scalars import GENESIS
from ..operators import chain, evidence, harvest, telemetry
from ..operators.budget import ADMISSION, _admit
from ..operators.chain import _extend
from ..operators.contradiction import RULES, Rule, group_of
from .ordered import Fold, Quarantine, in_order
from .timers import advance, removed, with_ticks

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """``work`` on every micro-batch; its rows go to <out>/batch=<id>, overwritten if the batch comes again."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _with_timers(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query whose state has timers: they need the RocksDB store. The session's own choice is put back."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(_STORE, before)


def _split_late(rows: DataFrame, out: str, checkpoint: str, once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Rows in time go to <out>/batch=<id>, late ones to <out>-late/batch=<id>; both are overwritten if the batch comes again."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.filter("NOT late").drop("late").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.filter("late").drop("late").write.mode("overwrite").parquet(f"{out}-late/batch={batch_id}")
        batch.unpersist()

    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _with_timers(rows.sparkSession, (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start)


def stream_ref_counts(changes: DataFrame, out: str, checkpoint: str, **how) -> StreamingQuery:
    """Net deltas of each micro-batch (R01); :func:`stream_apply_refs` brings them to a table."""
    return each_batch(changes, evidence.net_deltas, out, checkpoint, **how)


def write_ref_table(blocks: DataFrame, path: str, buckets: int = 64) -> None:
    """A table of reference counts (block_hash, ref_count) in hash buckets; ``applied`` is the last micro-batch that a bucket has."""
    bucket = F.pmod(F.xxhash64("block_hash"), F.lit(buckets)).cast("int")
    blocks.select("block_hash", F.col("ref_count").cast("long").alias("ref_count"), F.lit(-1).cast("long").alias("applied"), bucket.alias("bucket")).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)


def stream_apply_refs(changes: DataFrame, table: str, rejects: str, checkpoint: str, buckets: int = 64, once: bool = True, every: str = "5 seconds") -> StreamingQuery:
    """Reference counts of a table (see :func:`write_ref_table`) after each micro-batch of changes.

    Only the buckets that a batch touches are rewritten, each with the batch's id: a bucket that has it already is
    left alone, so a batch that comes again, or broke off between buckets, changes nothing twice. Bad changes and unknown
    hashes are listed in <rejects>/batch=<id> and change nothing.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = saved(evidence.valid_changes(batch))
        bucket = F.pmod(F.xxhash64("block_hash"), F.lit(buckets)).cast("int")
        good = checked.filter("reject_reason IS NULL").groupBy(F.col("hash").alias("block_hash")).agg(F.sum("delta").alias("delta"))
        nets = saved(good.withColumn("bucket", bucket))
        touched = [r[0] for r in nets.select("bucket").distinct().collect()]  # as many as buckets at most
        held = spark.read.parquet(table).filter(F.col("bucket").isin(touched))
        unknown = nets.join(held.select("bucket", "block_hash"), ["bucket", "block_hash"], "left_anti").select(F.col("block_hash").alias("hash"), "delta", F.lit("unknown_hash").alias("reject_reason"))
        checked.filter("reject_reason IS NOT NULL").unionByName(unknown).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        after = held.filter(F.col("applied") < batch_id).join(nets, ["bucket", "block_hash"], "left")
        after = written(after.select("block_hash", (F.col("ref_count") + F.coalesce("delta", F.lit(0))).cast("long").alias("ref_count"), F.lit(batch_id).cast("long").alias("applied"), "bucket"))
        after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    writer = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stream_harvest(messages: DataFrame, out: str, checkpoint: str, keywords: list[str], since: str | None = None, delay: str = "1 day", once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Harvested rows as messages arrive, each message (channel, ts) once, however often exports repeat it.

    Messages are remembered until ``delay`` behind the latest; older ones that come then are taken as repeats. Each
    batch also writes the latest time of every channel so far to <out>-marks/batch=<id> (see :func:`high_water_marks`).
    """
    spark = messages.sparkSession
    rows = messages if since is None else messages.filter(F.col("ts") >= since)
    seconds = F.coalesce(F.expr("try_cast(ts AS double)"), F.lit(0.0))
    fresh = rows.withColumn("_at", F.timestamp_micros((seconds * 1_000_000).cast("long"))).withWatermark("_at", delay).dropDuplicatesWithinWatermark(["channel_id", "ts"]).drop("_at")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        harvest.harvest(batch, keywords).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        marks = batch.select("channel_id", F.expr("try_cast(ts AS decimal(30, 6))").alias("mark"))
        if batch_id:
            marks = marks.unionByName(spark.read.parquet(f"{out}-marks/batch={batch_id - 1}"))
        marks.groupBy("channel_id").agg(F.max("mark").alias("mark")).write.mode("overwrite").parquet(f"{out}-marks/batch={batch_id}")
        batch.unpersist()

    writer = fresh.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def high_water_marks(spark: SparkSession, out: str) -> DataFrame:
    """channel_id and the latest message time that :func:`stream_harvest` has taken of it."""
    return spark.read.parquet(f"{out}-marks/batch={max(_numbered(spark, f'{out}-marks', 'batch'))}")


def messages_after(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """An export's messages later than their channel's mark: what the next scan has to hand on."""
    joined = small_join(messages, marks.select("channel_id", "mark"), ["channel_id"], "left")
    return joined.filter(F.col("mark").isNull() | (F.expr("try_cast(ts AS decimal(30, 6))") > F.col("mark"))).select(*messages.columns)


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders <path>/<name>=<number> that are whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    found = [x.getPath() for x in fs.listStatus(place) if x.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def stream_telemetry(events: DataFrame, out: str, checkpoint: str, every: str = "30 seconds", delay: str = "1 minute", kind: str = "kind", **how) -> StreamingQuery:
    """Counters per tumbling window, out when the watermark has passed."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return _run(counts.select(F.col("w.start").alias("window_start"), "kind", "n", "total"), out, checkpoint, **how)


def stream_percentiles(events: DataFrame, out: str, checkpoint: str, by: list[str], value: str, **how) -> StreamingQuery:
    """Exact percentiles of each flush: they are per flush, not cumulative."""
    return each_batch(events, lambda b: telemetry.latency_percentiles(b, by, value), out, checkpoint, **how)


def stream_payloads(events: DataFrame, out: str, checkpoint: str, window: str = "30 seconds", salt: str = "", size: int = telemetry.UPLOAD_ROWS, once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """The payloads of each flush (one row per window and tenant), numbered in uploads of ``size`` rows.

    A flush is a micro-batch: one every 30 seconds while the stream runs, and a last one over what is there when it
    is stopped by running it once more (``once``), so nothing waits for a watermark. Counters and features are also
    totalled over all flushes (total_*): a tenant's totals are kept in <out>-totals/batch=<id>, a row a tenant.
    Percentiles and errors are of the flush alone.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        past = spark.read.parquet(f"{out}-totals/batch={batch_id - 1}") if batch_id else None
        flush = saved(telemetry.with_totals(telemetry.telemetry_payload(batch, window, salt), past))
        telemetry.uploads(flush, size).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        telemetry.totals_after(flush, past).write.mode("overwrite").parquet(f"{out}-totals/batch={batch_id}")
        if batch_id > 1:
            removed(spark, f"{out}-totals/batch={batch_id - 2}")

    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stream_chain(writes: DataFrame, out: str, checkpoint: str, order: list[str], leaf: str = "leaf_hash", time: str = "ts", delay: str = "1 minute", **how) -> StreamingQuery:
    """Chains that grow as the watermark passes writes, in order of ``time`` and ``order`` (R05). State: root and height of a tenant."""
    rule = Fold(StructType.fromDDL("root string, height long"), (GENESIS, 0), lambda state, row: _extend(state, (row[leaf],)))
    return _split_late(in_order(writes, {"_tenant": F.col("tenant_id")}, time, delay, order, [leaf], "parent_root string, root_hash string, height long", rule), out, checkpoint, **how)


def stream_meter(requests: DataFrame, out: str, checkpoint: str, order: list[str], tokens: int, executions: int, time: str = "ts", delay: str = "1 minute", **how) -> StreamingQuery:
    """Budget admission in order of ``time`` and ``order`` (R06). State: balance, executions and the sticky status."""
    rule = Fold(StructType.fromDDL("tokens long, executions long, status string"), (tokens, executions, "active"), lambda state, row: _admit(state, (row["tokens_used"], row["executions_used"])))
    return _split_late(in_order(requests, {"_tenant": F.col("tenant_id")}, time, delay, order, ["tokens_used", "executions_used"], ADMISSION, rule), out, checkpoint, **how)


def stream_quarantine(proposals: DataFrame, out: str, checkpoint: str, order: list[str], rules: Rule | tuple[Rule, ...] = RULES, time: str = "created_at", delay: str = "1 minute", **how) -> StreamingQuery:
    """Quarantine in order of ``time`` and ``order``, with wildcard scopes and any number of rules.

    State is kept by tenant and group of rows that can meet, as in the batch's fold: a map from scope and term to the
    first surviving id, of which a row reads and writes its own few entries.
    """
    chosen = (rules,) if isinstance(rules, Rule) else tuple(rules)
    kind = proposals.schema["id"].dataType
    rows = in_order(proposals, {"_tenant": F.col("tenant_id"), "_group": group_of(chosen)}, time, delay, order, ["id", "title", "scope_domain", "scope_system", "status"], f"new_status string, conflicting_id {kind.simpleString()}", Quarantine(chosen, kind))
    return _split_late(rows, out, checkpoint, **how)


def stream_snapshots(ticks: DataFrame, chain_path: str, out: str, checkpoint: str, epoch: str = "current_timestamp()", **how) -> StreamingQuery:
    """A snapshot of every tenant that has a chain at each tick, whether it wrote since the last one or not.

    ``ticks`` is any stream: its micro-batches are the timer (:func:`clock` gives one). ``chain_path`` is the output of
    :func:`stream_chain`. The root of each tenant is kept in <out>-roots/tick=<id>, with the number of the last batch
    of the chain that it is from: a tick reads that table, a row a tenant, and the chain's batches since. Each
    snapshot is over the hash of the tenant's one of the tick before. A tick that comes again starts from the same tick before.
    """
    spark = ticks.sparkSession
    kept = "tenant_id string, root_hash string, height long, through long"

    def sink(_: DataFrame, tick: int) -> None:
        past = spark.read.schema(kept).parquet(f"{out}-roots/tick={tick - 1}") if tick else spark.createDataFrame([], kept)
        through = past.agg(F.max("through")).first()[0]
        new = [k for k in _numbered(spark, chain_path, "batch") if through is None or k > through]
        roots = past.drop("through")
        if new:
            fresh = spark.read.parquet(*[f"{chain_path}/batch={k}" for k in new])
            roots = chain.chain_roots(roots.unionByName(fresh.select("tenant_id", "root_hash", "height")))
        roots = saved(roots.withColumn("through", F.lit(new[-1] if new else through).cast("long")))
        roots.write.mode("overwrite").parquet(f"{out}-roots/tick={tick}")
        schema = "tenant_id string, root_hash string, block_height long, parent_snapshot_hash string, snapshot_hash string, epoch_unix long"
        before = spark.read.schema(schema).parquet(f"{out}/batch={tick - 1}") if tick else spark.createDataFrame([], schema)
        chain.snapshot_step(roots, before.withColumn("epoch_timestamp", F.col("epoch_unix")), F.expr(epoch)).write.mode("overwrite").parquet(f"{out}/batch={tick}")
        if tick > 1:
            removed(spark, f"{out}-roots/tick={tick - 2}")

    writer = ticks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    once, every = how.get("once", True), how.get("every", "30 seconds")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def clock(spark: SparkSession) -> DataFrame:
    """A stream that has something new at every trigger, with the time as ``at``: the timer of periodic jobs."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("timestamp").alias("at"))


def stream_expire(decisions: DataFrame, ticks: DataFrame, out: str, checkpoint: str, expiry: str = "valid_to", keys: list[str] | None = None, order: list[str] = ["updated_at"], once: bool = True, every: str = "30 seconds", final: tuple[str, ...] = ("executed", "stale"), buckets: int = 64) -> StreamingQuery:  # noqa: B006
    """Decisions as they come, and again as stale at the first tick after their expiry, without coming again.

    ``ticks`` is a stream of times ``at``, such as :func:`clock`; its latest is the time. Each decision (``keys``) has one
    timer, set anew when it comes with another validity; rows with a ``final`` status, or without an expiry, have none.
    Of one batch's rows the last by ``order`` counts. Changes go to <out>/batch=<id>, numbered by ``version``; :func:`as_of_now` makes the table of
    them. Timers lie in hash buckets, of which a batch reads those that it touches (see :mod:`.timers`).
    """
    keys = keys or [c for c in ("tenant_id", "id") if c in decisions.columns]
    due = F.when(~F.coalesce(F.col("status").isin(*final), F.lit(False)), F.unix_millis(F.col(expiry).cast("timestamp")) + 1)  # stale from the next millisecond on
    times = {f.name: f.dataType for f in decisions.schema if f.name == "updated_at"}

    def fired(at: Column) -> dict[str, Column]:
        return {"status": F.lit("stale")} | {c: at.cast(kind) for c, kind in times.items()}

    def sink(batch: DataFrame, batch_id: int) -> None:
        advance(batch, batch_id, out, keys, order, fired, buckets)

    writer = with_ticks(decisions, ticks, due).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def as_of_now(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each decision in the log of :func:`stream_expire`."""
    rest = [c for c in changes.columns if c not in (*keys, "version", "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_last")).select(*keys, "_last.*")


def finished(query: StreamingQuery, spark: SparkSession, out: str) -> DataFrame:
    """Waits for a run over what was available, and reads its output."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(out)
