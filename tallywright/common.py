"""Helpers of the ledger operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A side of a join is broadcast only after its values were measured to be at most this many bytes.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the cluster's spark.checkpoint.dir.

    Where it is unset, a temporary folder is used if the master is local, as in tests; elsewhere that is an error,
    since executors would not see it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ledger-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder: the lineage of a loop ends here, and lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """As :func:`saved`, by way of a table. For loops that join a table with itself: a checkpoint keeps how its rows are sorted and dealt, told over all of a loop's joins, which soon takes planning longer than the work. ``codec``: zstd takes half the place for hashes as text."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def replaced(df: DataFrame, *old: DataFrame | None) -> DataFrame:
    """:func:`written`, after which the tables of ``old`` go: for loops whose next table is all that is left of the last. Only tables that nothing else reads."""
    out = written(df)
    spark = df.sparkSession
    for o in old:
        if path := getattr(o, "_written", None):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return out


def _width(c: Column, kind: DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, ArrayType):
        return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(16).cast("long"), lambda acc, x: acc + _width(x, kind.elementType))
    if isinstance(kind, MapType):
        return _width(F.map_entries(c), ArrayType(StructType().add("key", kind.keyType).add("value", kind.valueType)))
    return F.lit(8)


def byte_size(df: DataFrame) -> int:
    """Bytes that the rows take, about, measured over all of them."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8)).cast("long")
    return df.select(row.alias("w")).agg(F.sum("w")).first()[0] or 0


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Broadcasts the small side only if its measured bytes allow it; else a plain join."""
    return big.join(F.broadcast(small) if byte_size(small) <= BROADCAST_BYTES else small, on, how)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the key's rows up to this one by ``order``.

    No task sees a whole key. Rows are dealt by ranges of (key, order), equal ones together; each range is summed by
    key, the sums are run over the ranges of a key (as many rows as ranges at most), and rows are run within theirs.
    """
    ranged = saved(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bases = bases.select(F.col("_range").alias("_r"), "_base", *[F.col(k).alias(f"_k_{k}") for k in keys])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_sum", F.sum(value).over(inside))
    match = F.col("_range") == F.col("_r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(bases, match).withColumn(name, F.col("_sum") + F.col("_base")).select(*df.columns, name)


def present(value) -> bool:
    """Whether an optional filter is set: None, '' and an empty list mean "any"."""
    return value is not None and value != "" and value != []
