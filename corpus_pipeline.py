"""The corpus pipeline: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder
and reads it again as the next stage's documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, extra columns and empty tables: null
texts count as empty (the masked text of one is null), rows are told apart by more than their ids, other columns are
not carried on, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import mixing, neardup, packing, pii, quality
from tallywright.llm.common import read, shared_folder, small_join
from tallywright.llm.queries import vocabulary

#: Documents this similar (percent of their five-word shingles in common) are copies of each other.
SIMILAR = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What the third stage adds to the columns of documents for the fourth: it tells written rows apart.
ROW = "_pipeline_row"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labelled rows among all documents."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return docs.withColumn("_score", quality.score_column(docs, model)).filter(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: one with the smallest id, null ids last.

    Rows are told apart by a hash of id and text, so an id's rows with other texts and rows without an id are
    documents of their own. Of rows with the same id and text, and of an id's rows without words, one stays.
    """
    # 64 bits, as for shingles: two of 10**8 documents meet with a chance of 3 in 10**4.
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text").isNull(), F.coalesce("text", F.lit(""))))
    linked = neardup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), SIMILAR).select(F.col("doc_id").alias("_key"), "n_shingles", "component_id").distinct()
    ids = keyed.groupBy("_key").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    rows = neardup.saved(linked.join(ids, "_key"))
    wordless = F.col("n_shingles") == 0
    groups = rows.groupBy(wordless.alias("_w"), F.when(wordless, F.col("doc_id")).otherwise(F.col("component_id")).alias("_g"))
    best = groups.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("m")).select(F.col("m._key").alias("_key"), F.lit(True).alias("_best"))
    marked = neardup.saved(rows.join(best, "_key", "left").filter("_best IS NULL OR n > 1").select("_key", "_best"))
    single = small_join(keyed, marked.select("_key"), ["_key"], "left_anti").select(*COLUMNS)
    several = marked.filter("_best").select("_key")
    if several.isEmpty():
        return single
    repeated = small_join(keyed, several, ["_key"], "left_semi").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("m"))
    return single.unionByName(repeated.select("m.*"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by the names of its kinds, and ROW, which tells rows apart in what is written."""
    text = pii.masked_column(pii.fitted(docs))
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS, F.monotonically_increasing_id().alias(ROW))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words: whole copies for each full size taken, and one more where half of it or more is left over.

    A row of which the mix takes less than half its words goes. Rows are joined by ROW, so ids may be null or repeated;
    where the input has no such column, rows are numbered and kept first.
    """
    if ROW not in docs.columns:
        docs = mixing.saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)))
    shares = mixing.saved(mixing.mix(docs, row=ROW).select(ROW, "size", "taken"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    counted = shares.select(ROW, times.alias("_times")).filter("_times > 0")
    joined = small_join(docs.select(*COLUMNS, ROW), counted, [ROW])
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, vocabulary)


STAGES = [
    ("quality classifier", keep_good),
    ("minhash near-dedup", drop_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: No stage but the near-duplicates' can be said in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
