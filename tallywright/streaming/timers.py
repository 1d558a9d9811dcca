"""Timers by key over micro-batches, as joins of tables: no call to Python a key.

What is held of a key lies in a table of hash buckets. A micro-batch reads and writes anew the buckets in which a key comes
or a timer is due, in a folder of its own number; <out>-places/batch=<id> names the folder of each bucket after that batch, its earliest timer and
the time. A batch that comes again starts from the places of the one before, so it gives the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..common import written

_PLACES = "bucket int, at long, soonest long, clock long"


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def with_ticks(decisions: DataFrame, ticks: DataFrame, due: Column) -> DataFrame:
    """One stream of decisions, with the millisecond ``_due`` of their timer, and of ticks, whose other columns are null."""
    rows = decisions.withColumns({"_due": due.cast("long"), "_tick": F.lit(None).cast("long"), "_comes": F.lit(True)})
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in decisions.schema]
    return rows.unionByName(ticks.select(*nothing, F.lit(None).cast("long").alias("_due"), F.unix_millis(F.col("at").cast("timestamp")).alias("_tick"), F.lit(False).alias("_comes")))


def _marked(held: DataFrame, came: DataFrame, keys: list[str], order: list[str], now: int | None) -> DataFrame:
    """Held and new rows with ``_n``, their version, and whether they are their key's last and whether its timer fires."""
    both = held.withColumn("_new", F.lit(False)).unionByName(came.withColumns({"_version": F.lit(1).cast("long"), "_new": F.lit(True)}))
    by = Window.partitionBy("_bucket", *[F.col(f"`{k}`") for k in keys]).orderBy("_new", *[F.col(f"`{c}`") for c in order])
    numbered = both.repartition("_bucket").withColumns({"_n": F.sum("_version").over(by.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.lead("_new").over(by).isNull()})
    return numbered.withColumn("_fires", F.col("_last") & F.coalesce(F.col("_due") <= F.lit(now).cast("long"), F.lit(False)))


def advance(batch: DataFrame, batch_id: int, out: str, keys: list[str], order: list[str], fired: Callable[[Column], dict[str, Column]], buckets: int) -> None:
    """One micro-batch of :func:`with_ticks`: new rows, then timers that are due, go to <out>/batch=<id>, numbered by ``version`` within their key.

    ``fired`` gives the columns that a row has from its timer on, from the time. A key's last row is held until its
    timer has fired; the number of its last version stays.
    """
    spark = batch.sparkSession
    own = [f for f in batch.schema if f.name not in ("_due", "_tick", "_comes")]
    names = [F.col(f"`{f.name}`") for f in own]
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")
    rows = batch.withColumn("_bucket", bucket).persist()
    places = {r["bucket"]: r for r in spark.read.schema(_PLACES).parquet(f"{out}-places/batch={batch_id - 1}").collect()} if batch_id else {}  # a row a bucket
    tick, come = rows.agg(F.max("_tick"), F.collect_set(F.when(F.col("_comes"), F.col("_bucket")))).first()
    now = max((t for t in (tick, *(r["clock"] for r in places.values())) if t is not None), default=None)
    due = {b for b, r in places.items() if now is not None and r["soonest"] is not None and r["soonest"] <= now}
    touched = sorted({*come, *due})
    held = StructType([*own, StructField("_due", LongType()), StructField("_version", LongType())])
    paths = [f"{out}-held/batch={places[b]['at']}/_bucket={b}" for b in touched if b in places]
    past = (spark.read.schema(held).parquet(*paths) if paths else spark.createDataFrame([], held)).withColumn("_bucket", bucket)
    marked = written(_marked(past, rows.filter("_comes").select(*names, "_due", "_bucket"), keys, order, now))
    rows.unpersist()
    stale = marked.filter("_fires").withColumns(fired(F.timestamp_millis(F.lit(now).cast("long")))).select(*names, (F.col("_n") + 1).alias("version"))
    marked.filter("_new").select(*names, F.col("_n").alias("version")).unionByName(stale).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    waits = F.col("_due").isNotNull() & ~F.col("_fires")
    kept = [F.col(f"`{f.name}`") if f.name in keys else F.when(waits, F.col(f"`{f.name}`")).alias(f.name) for f in own]
    last = marked.filter("_last").select(*kept, F.when(waits, F.col("_due")).alias("_due"), (F.col("_n") + F.col("_fires").cast("long")).alias("_version"), "_bucket")
    last.write.mode("overwrite").partitionBy("_bucket").parquet(f"{out}-held/batch={batch_id}")
    soonest = {r["_bucket"]: r["m"] for r in marked.filter("_last").groupBy("_bucket").agg(F.min(F.when(waits, F.col("_due"))).alias("m")).collect()}
    after = {b: (b, r["at"], r["soonest"], now) for b, r in places.items()} | {b: (b, batch_id, m, now) for b, m in soonest.items()} | {-1: (-1, None, None, now)}
    spark.createDataFrame(list(after.values()), _PLACES).coalesce(1).write.mode("overwrite").parquet(f"{out}-places/batch={batch_id}")
    removed(spark, marked._written)
    if batch_id > 1:  # a batch that comes again reads the places of the one before, so older ones may go
        older = spark.read.schema(_PLACES).parquet(f"{out}-places/batch={batch_id - 2}").collect()
        for r in older:
            if r["at"] is not None and places[r["bucket"]]["at"] != r["at"]:
                removed(spark, f"{out}-held/batch={r['at']}/_bucket={r['bucket']}")
        removed(spark, f"{out}-places/batch={batch_id - 2}")
