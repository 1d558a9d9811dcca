"""Streams over several micro-batches give what their batch operators give over all rows."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tallywright.operators import budget, chain, contradiction, evidence, harvest, telemetry
from tallywright.sources.tables import read_messages
from tallywright.streaming import jobs


def parts(spark, df, path, order, n=3):
    """The rows in files whose times follow ``order``: one file is one micro-batch."""
    rows = df.orderBy(*order).collect()
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def same(a, b):
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "log")


def shuffled(spark, df, path, n=10, seed=4):
    """The rows in no order over ``n`` micro-batches, and a last one that is far later."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    later(spark, df, path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def later(spark, df, path, at="2100-01-01 00:00:00"):
    spark.range(1).select(*[(F.lit(at) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]).coalesce(1).write.mode("append").parquet(str(path))


def timed(df):
    """A time for each id, two ids sharing one now and then."""
    return df.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") / 2) * 60))


def test_chain_in_any_order_of_arrival(spark, tmp_path, places):
    df = timed(spark.range(40).select((F.col("id") % 3).cast("string").alias("tenant_id"), "id", F.sha2(F.col("id").cast("string"), 256).alias("leaf_hash")))
    stream = shuffled(spark, df, tmp_path / "in")
    same(jobs.finished(jobs.stream_chain(stream, *places, ["id"], delay="1 day"), spark, places[0]).drop("batch"), chain.chain(df, ["ts", "id"]))
    assert spark.read.parquet(f"{places[0]}-late").count() == 0


def test_meter_in_any_order_of_arrival(spark, tmp_path, places):
    df = timed(spark.range(60).select((F.col("id") % 2).cast("string").alias("tenant_id"), "id", (F.col("id") * 7 % 13).alias("tokens_used"), F.lit(1).cast("long").alias("executions_used")))
    stream = shuffled(spark, df, tmp_path / "in", 4)
    same(jobs.finished(jobs.stream_meter(stream, *places, ["id"], 100, 20, delay="1 day"), spark, places[0]).drop("batch"), budget.meter(df, ["ts", "id"], 100, 20))


def test_late_rows_go_to_the_side(spark, tmp_path, places):
    """A row that comes after its tenant was advanced beyond its time changes nothing; one without a time neither."""
    schema = "tenant_id string, id long, leaf_hash string, ts timestamp"
    write = lambda rows: spark.createDataFrame(rows, "tenant_id string, id long, leaf_hash string, s long").select("tenant_id", "id", "leaf_hash", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: jobs.finished(jobs.stream_chain(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), *places, ["id"], delay="10 seconds"), spark, places[0])
    write([("a", 2, "y", 1020), ("a", 1, "x", 1010), ("a", 3, "z", 1100)])
    assert sorted((r["id"], r["height"]) for r in run().collect()) == [(1, 1), (2, 2)]
    write([("a", 9, "late", 1015), ("b", 5, "other tenant, nothing before", 1015), ("a", 8, "no time", None), ("a", 4, "w", 1095), ("a", 6, "end", 2000)])
    assert sorted((r["tenant_id"], r["id"], r["height"]) for r in run().collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 4), ("a", 4, 3), ("b", 5, 1)]
    assert sorted((r["id"], r["root_hash"]) for r in spark.read.parquet(f"{places[0]}-late").collect()) == [(8, None), (9, None)]


def test_quarantine_in_any_order_of_arrival(spark, tmp_path, places):
    titles = F.array(*[F.lit(x) for x in ("Postgres", "MongoDB", "both postgres mongodb", "cache", "queue")])
    df = timed(spark.range(80).select((F.col("id") % 2).cast("string").alias("tenant_id"), "id", F.element_at(titles, (F.col("id") * 11 % 5 + 1).cast("int")).alias("title"), F.lit("draft").alias("status"), F.lit("d").alias("scope_domain"), F.when(F.col("id") % 3 > 0, "db").otherwise("api").alias("scope_system"), F.col("id").alias("created_at")))
    stream = shuffled(spark, df, tmp_path / "in", 4)
    got = jobs.finished(jobs.stream_quarantine(stream, *places, ["id"], time="ts", delay="1 day"), spark, places[0])
    want = contradiction.quarantine(df).filter("status = 'quarantined'").select("id", "conflicting_id")
    same(got.filter("new_status = 'quarantined'").select("id", "conflicting_id"), want)


def test_decisions_expire_as_time_passes(spark, tmp_path, places):
    """One that arrives valid becomes stale at a later tick without coming again; another is given longer before its time."""
    t = lambda s: None if s is None else f"timestamp_seconds({s})"
    kept, clock = "id long, status string, valid_to timestamp, updated_at timestamp", "at timestamp"

    def write(rows, now):
        for k, (i, status, to, at) in enumerate(rows):
            spark.range(1).selectExpr(f"{i}L AS id", f"'{status}' AS status", f"CAST({t(to) or 'NULL'} AS TIMESTAMP) AS valid_to", f"{t(at)} AS updated_at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if now:
            spark.range(1).selectExpr(f"{t(now)} AS at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        streams = [spark.readStream.schema(s).parquet(f"{tmp_path}/{p}") for s, p in ((kept, "in"), (clock, "ticks"))]
        out = jobs.finished(jobs.stream_expire(*streams, *places), spark, places[0])
        return {r["id"]: (r["status"], r["updated_at"].timestamp()) for r in jobs.as_of_now(out, ["id"]).collect()}

    assert write([(1, "draft", 100, 1), (2, "draft", 100, 2), (3, "executed", 100, 3), (4, "draft", None, 4), (5, "draft", 40, 5)], 50) == {1: ("draft", 1), 2: ("draft", 2), 3: ("executed", 3), 4: ("draft", 4), 5: ("stale", 50)}
    assert write([(2, "approved", 300, 60)], 100)[1] == ("draft", 1)
    assert write([], 200) == {1: ("stale", 200), 2: ("approved", 60), 3: ("executed", 3), 4: ("draft", 4), 5: ("stale", 50)}
    assert write([], 301)[2] == ("stale", 301)


def test_counts_are_applied_once(spark, tmp_path):
    """Over several batches counts are those of the batch operator; a batch that comes again changes nothing; bad and unknown changes are listed."""
    h = [f"{k:064x}" for k in range(30)]
    table, rejects = str(tmp_path / "counts"), str(tmp_path / "rejects")
    blocks = spark.createDataFrame([(x, 100) for x in h[:25]], "block_hash string, ref_count long")
    jobs.write_ref_table(blocks, table, 8)
    rows = [(h[k % 26], str(k % 5 - 2), k) for k in range(90)] + [("short", "1", 90), (h[1], "x", 91), (None, "1", 92)]
    df = spark.createDataFrame(rows, "hash string, delta string, k int")
    read = lambda: sorted((r["block_hash"], r["ref_count"]) for r in spark.read.parquet(table).collect())
    want = sorted((r["block_hash"], r["ref_count"]) for r in evidence.apply_deltas(blocks, evidence.net_deltas(df)).collect())
    run = lambda log: jobs.finished(jobs.stream_apply_refs(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), table, rejects, str(tmp_path / log), 8), spark, table)
    parts(spark, df, tmp_path / "in", ["k"])
    run("log")
    assert read() == want
    run("again")  # a fresh log: all batches come again under their numbers
    assert read() == want
    bad = {(r["hash"], r["reject_reason"]) for r in spark.read.parquet(rejects).collect()}
    assert bad == {("short", "bad_hash"), (h[1], "bad_delta"), (None, "bad_hash"), (h[25], "unknown_hash")}


def test_overlapping_exports_give_each_message_once(spark, tmp_path, places):
    rows = [(c, f"{100 + k}.000200", f"We decided to take {c}{k}. ") for c in "ab" for k in range(12)]
    exports = [rows[:10], rows[6:18], rows[:24], rows[20:]]
    for e in exports:
        spark.createDataFrame(e, "channel_id string, ts string, text string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema("channel_id string, ts string, text string").json(f"{tmp_path}/in")
        got = jobs.finished(jobs.stream_harvest(stream, *places, harvest.KEYWORDS), spark, places[0])
    every = read_messages(spark, f"{tmp_path}/in")
    same(got.drop("batch"), harvest.harvest(every.distinct(), harvest.KEYWORDS))
    marks = jobs.high_water_marks(spark, places[0])
    assert {r["channel_id"]: str(r["mark"]) for r in marks.collect()} == {"a": "111.000200", "b": "111.000200"}
    more = spark.createDataFrame([("a", "111.000200", "seen"), ("a", "111.000300", "new"), ("c", "1.0", "new channel")], every.schema)
    assert sorted(r["text"] for r in jobs.messages_after(more, marks).collect()) == ["new", "new channel"]


def usage(spark, n, seed):
    rng = random.Random(seed)
    kinds = ["proposed", "reused", "detected", "feature", "error"]
    rows = [(rng.choice("ab"), rng.choice(kinds), rng.choice(["x", "y", "z"]), rng.randrange(5000), rng.randrange(100), "m", 1_700_000_000 + rng.randrange(120)) for _ in range(n)]
    df = spark.createDataFrame(rows, "tenant_id string, kind string, name string, latency_us long, tokens long, model string, s long")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_payload_totals_go_over_flushes(spark, tmp_path, places):
    """Counters and features of a flush on top of those before; the last run is the flush on stop."""
    flushes = [usage(spark, 60, k) for k in range(3)]
    for f in flushes:
        f.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(flushes[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.finished(jobs.stream_payloads(stream, *places, "30 seconds", "s"), spark, places[0]).orderBy("tenant_hash", "batch", "window_start").collect()
    counters = ["proposed", "reused", "detected", "tokens_saved"]
    sums, features = {}, {}
    for r in got:
        key = r["tenant_hash"]
        for name, n in json.loads(r["features"] or "{}").items():
            features[key, name] = features.get((key, name), 0) + n
        for c in counters:
            sums[key, c] = sums.get((key, c), 0) + r[c]
            assert r[f"total_{c}"] == sums[key, c]
        assert dict(r["total_features"]) == {name: n for (k, name), n in features.items() if k == key}
    every = flushes[0].unionByName(flushes[1]).unionByName(flushes[2])
    assert sum(n for (_, c), n in sums.items() if c == "proposed") == every.filter("kind = 'proposed'").count()
    assert sorted(int(p.split("=")[1]) for p in os.listdir(f"{places[0]}-totals")) == [1, 2]


def test_snapshots_by_the_clock(spark, tmp_path, places):
    """The clock ticks while no tenant writes; a tick reads only the chain's new batches."""
    leaves = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "tenant_id string, id long, leaf_hash string")
    chain.chain(leaves, ["id"]).write.parquet(f"{tmp_path}/chain/batch=0")
    query = jobs.stream_snapshots(jobs.clock(spark), f"{tmp_path}/chain", *places, once=False, every="2 seconds")
    end = time.time() + 90
    while time.time() < end and (query.lastProgress is None or query.lastProgress["batchId"] < 2):
        time.sleep(0.5)
    query.stop()
    rows = spark.read.parquet(places[0]).collect()
    by = {(r["tenant_id"], r["batch"]): r for r in rows}
    assert len({b for _, b in by}) >= 2
    assert all(by[t, b]["parent_snapshot_hash"] == (by[t, b - 1]["snapshot_hash"] if b else "") for t, b in by)
    assert {r["through"] for r in spark.read.parquet(f"{places[0]}-roots").collect()} == {0}


def test_percentiles_of_each_flush(spark, tmp_path, places):
    df = spark.range(30).select((F.col("id") % 2).cast("string").alias("kind"), "id", (F.col("id") * 13 % 31).alias("v"))
    stream = parts(spark, df, tmp_path / "in", ["id"])
    got = jobs.finished(jobs.stream_percentiles(stream, *places, ["kind"], "v"), spark, places[0])
    want = telemetry.latency_percentiles(df.withColumn("batch", F.floor(F.col("id") / 10).cast("int")), ["batch", "kind"], "v")
    same(got, want)


def test_deltas(spark, tmp_path, places):
    h = ["ab" * 32, "cd" * 32]
    df = spark.createDataFrame([(h[k % 2], str(k % 3 - 1), k) for k in range(30)], "hash string, delta string, k int")
    stream = parts(spark, df, tmp_path / "in", ["k"])
    got = jobs.finished(jobs.stream_ref_counts(stream, *places), spark, places[0]).groupBy("hash").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    same(got, evidence.net_deltas(df))
