"""The mix meets the targets of small sources and of small tables."""

from pyspark.sql import functions as F

from tallywright.llm import mixing


def mixed(spark, sizes):
    rows = [(k, " ".join(["w"] * n), source) for k, (source, n) in enumerate(sizes)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    return out


def test_a_long_tail_of_small_sources_gets_its_words(spark):
    out = mixed(spark, [(f"s{k:04d}", (10, 33, 40, 7)[k % 4]) for k in range(600)] + [("big", 6000)])
    for size in (10, 33, 40, 7):
        own = [r for r in out if r["source_size"] == size]
        want = sum(r["target"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want) <= 0.06 * want


def test_a_tiny_table_is_not_left_empty(spark):
    (row,) = mixed(spark, [("a", 5)])
    assert row["target"] == 7.5 and row["taken"] in (5, 10)


def test_permutations_are_whole_and_vary(spark):
    """Each grid's numbers go to all its places, otherwise for each key; over many keys every place is as likely."""
    grids = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 4), (3, 4), (7, 7), (30, 31), (100, 103)]
    cells = spark.createDataFrame([(r, c, k, i) for r, c in grids for k in range(4) for i in range(r * c)], "rows long, columns long, key long, index long")
    got = {}
    for r in mixing.permuted(cells).collect():
        got.setdefault((r["rows"], r["columns"], r["key"]), {})[r["index"]] = r["to"]
    for (rows, columns, _), places in got.items():
        assert sorted(places.values()) == list(range(rows * columns))
    for k in range(1, 4):
        same = sum(got[100, 103, 0][i] == got[100, 103, k][i] for i in range(10300))
        assert same < 12  # one in the mean
    # Neighbours do not stay neighbours.
    assert sum(abs(got[100, 103, 0][i] - got[100, 103, 0][i + 1]) == 1 for i in range(10299)) < 15
    keys = spark.range(12000).select((F.col("id") * 7919).alias("key"), F.lit(5).cast("long").alias("index"), F.lit(3).cast("long").alias("rows"), F.lit(4).cast("long").alias("columns"))
    counts = {r["to"]: r["count"] for r in mixing.permuted(keys).groupBy("to").count().collect()}
    assert sorted(counts) == list(range(12)) and all(850 < n < 1150 for n in counts.values())


def test_grids_hold_the_words(spark):
    """A grid has no more blocks than its source has words, none is over BLOCK words, and it adds at most a row."""
    sizes = spark.range(0, 40000).select("id", F.col("id").alias("source_size"), F.col("id").cast("double").alias("target"))
    bad = mixing.wanted(sizes).filter("n_blocks > source_size OR n_blocks * 32 < source_size OR n_blocks >= ceil(source_size / 32) + rows OR (source_size = 0 AND room > 0)")
    assert bad.count() == 0
