"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: The word separators of the corpus operators: ASCII white space only.
SPACES = " \t\n\x0b\f\r"
#: A side of a join is broadcast only after its values were measured, or counted at a known width, to be at most this many bytes.
BROADCAST_BYTES = 32 << 20
#: Rows per group of texts that a Python task holds at once end at this many characters.
CHUNK_CHARS = 1_000_000
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set, a temporary folder if the master is local (tests); else an error, as executors would not see it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared checkpoint folder: cuts the lineage, survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As :func:`saved`, by way of a table. For loops that join a table with itself: a checkpoint keeps how its rows are sorted and dealt, told over all of a loop's joins, which soon takes planning longer than the work."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(c: Column, kind: DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)):
            return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(16).cast("long"), lambda acc, x: acc + _width(x, kind.elementType))
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
    return F.lit(8)


def byte_size(df: DataFrame) -> int:
    """Bytes that the rows take, about, measured over all of them."""
    row = sum((_width(F.col(f.name), f.dataType) for f in df.schema), F.lit(8)).cast("long")
    return df.select(row.alias("w")).agg(F.sum("w")).first()[0] or 0


def small_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a table that is usually small: broadcast only if its bytes allow it, else a plain shuffle join.

    Bytes are measured, or, where ``rows`` are known, taken at 64 a row: for tables of a few numbers and short keys.
    """
    size = byte_size(small) if rows is None else rows * 64
    return big.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, list(on), how)


def bucket_count(rows: int) -> int:
    """Buckets for :func:`numbered`: a few hundred rows each, at most 100,000 buckets a group."""
    return max(1, min(-(-rows // 200), 100_000))


def numbered(df: DataFrame, groups: Sequence[str], spread: Column, order: Sequence[str | Column], rows: int, name: str, weight: str | None = None) -> DataFrame:
    """Adds ``name``: each row's place in its group from 0, or with ``weight`` the sum of the weights before it.

    No task sees a whole group. Rows go to buckets by ``spread`` (an integer Column); buckets are summed, sums
    are run over the buckets of a group, and places are counted within one bucket. Equal rows keep any order
    among themselves; every run gives the same numbers to the same set of rows.
    """
    k = bucket_count(rows)
    keyed = df.withColumn("_bucket", F.pmod(spread, F.lit(k)))
    keys = [*groups, "_bucket"]
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy(*keys).agg(amount.alias("_n")).select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    place = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(inside) - 1
    placed = keyed.withColumn("_place", place)
    match = F.col("_bucket") == F.col("_b")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return placed.join(bases, match).withColumn(name, (F.col("_place") + F.col("_base")).cast("long")).select(*df.columns, name)


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name``: each row's place among all rows by ``order``, from 1; ``df`` reads rows that are saved.

    Rows are dealt by ranges of the order (equal ones by row, so they split too), counted by range, and placed within
    theirs: no task sees all rows. As many counts as ranges go through one task.
    """
    ranged = saved(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie")))
    return placed.join(bases, F.col("_range") == F.col("_r")).withColumn(name, (F.col("_place") + F.col("_base")).cast("long")).select(*df.columns, name)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS: documents are long, and a task holds a batch on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives what a task has freed back to the machine: Python workers live on and are shared by all stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = CHUNK_CHARS) -> Iterator[pa.Table]:
    """Arrow batches cut so that each part has about ``chars`` bytes of text; a longer text is alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist() if batch.num_rows else []
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > chars:
                yield pa.Table.from_batches([batch.slice(begin, i - begin)])
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield pa.Table.from_batches([batch.slice(begin)])


def map_texts(df: DataFrame, schema: str, work: Callable[[pa.Table], dict[str, list]], text: str = "text", chars: int = CHUNK_CHARS) -> DataFrame:
    """``work`` turns a part of the rows into columns of ``schema``; it runs where the rows are, without a shuffle."""
    small_batches(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, chars):
            columns = work(part)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
        release()

    return df.mapInArrow(run, schema)
