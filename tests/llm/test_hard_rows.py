"""Hard rows for the classifier, packing and every stage of the pipeline: nulls, empty and long texts, repeats, clashing columns, empty tables."""

from collections import Counter

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from tallywright.llm import packing, quality
from tallywright.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _key string, quality string, r string, _score string, held_out string, size string"
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one two three", "en", "a", 13),
    (3, "one two three", "en", "a", 13),
    (3, "another text of the same id, rather longer than the first", None, "b", 1),
    (None, "no id here at all, and nothing else to tell", "en", None, 1),
    (None, "no id here at all, and nothing else to tell", "en", None, 1),
    (4, "word " * 20_000, "fr", "c", 1),
    (5, "mail me at a.b@example.org or 10.1.2.3 please", "en", "a", 1),
    (6, " \n\t ", "en", "a", 1),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_classifier_with_repeated_ids_and_clashing_columns(spark, hard):
    labels = spark.createDataFrame([(3, 1, 0, "x"), (3, 0, 0, "x"), (4, 1, 0, "x"), (2, 0, 1, "x"), (6, 0, 0, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    one, two = (sorted(map(repr, quality.classify(df, labels).collect())) for df in (hard, hard.orderBy(F.desc("text"))))
    assert one == two and len(one) == len(ROWS)


def test_stages_on_hard_rows(spark, hard):
    every = listed(hard)
    good = p.keep_good(spark, hard, SF)
    assert good.columns == p.COLUMNS and listed(good) <= every
    single = listed(p.drop_copies(spark, hard, SF))
    assert single <= every and max(single.values()) == 1 and {(4, ROWS[7][1]), (5, ROWS[8][1]), (None, ROWS[5][1]), (3, ROWS[2][1]), (3, ROWS[4][1])} <= set(single)
    masked = p.mask_personal_data(spark, hard, SF)
    texts = listed(masked)
    assert sum(texts.values()) == len(ROWS) and texts[1, None] == 1 and texts[5, "mail me at <EMAIL> or <IP> please"] == 1
    mixed = listed(p.mix_sources(spark, hard, SF))
    assert all(n <= 2 * every[k] for k, n in mixed.items())
    packed = p.pack_windows(spark, hard, SF).collect()
    ends = Counter(r["doc_id"] for r in packed if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == Counter(r[0] for r in ROWS)


def test_stages_on_empty_tables(spark, none):
    for _, stage in p.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_packing_leaves_little_padding(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), vocabulary).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("padded").alias("padded")).collect()
    tokens, padded = sum(r["n"] for r in rows), sum(r["padded"] for r in rows)
    assert 1 - tokens / padded <= 0.02, (tokens, padded)
