"""Lexical search, nearest neighbours and resampling: against SQL or brute force, and on hard rows."""

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallywright.llm import lexical, nearest, resampling
from tallywright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, n long, item string, terms string, rank string, _range string, score string"
HARD = [
    (1, None),
    (2, ""),
    (3, " \n--\t "),
    (4, "one two three"),
    (4, "one two three"),
    (5, "one two three"),
    (None, "one two three"),
    (None, "one"),
    (6, "é ☃ \U0001f600 \x85   Ab " * 30),
    (7, "Word " * 30_000 + "two"),
    (8, "x" * 200_000),
    (9, "one " * 25),
    (9, "one " * 25),
    (10, "中文" * 5000 + " three"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, 7, "x", "x", "x", "x", "x") for i, t in HARD], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "one TWO", 1), (1, "one TWO", 1), (2, None, 1), (3, "", 1), (None, "three Ab é", 1), (4, "nowhere", 1), (5, "word " * 40_000 + "x" * 200_000, 1)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def oracle(name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(table, df.select(*[c for c in ("doc_id", "item_id", "text") if c in df.columns]).toArrow())
    return sorted(map(str, con.sql(ORACLES[name]).fetchall()))


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_ranked_lexical_search", "op13_importance_resampling"])
def test_queries_equal_sql(spark, name):
    assert rows(QUERIES[name](spark, SF)) == oracle(name, **{t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")})


def test_search_on_hard_rows(hard, items):
    assert rows(lexical.search(hard, items)) == oracle("op11_ranked_lexical_search", documents=hard, benchmark=items)


def test_search_of_empty_tables(spark, hard, items):
    assert lexical.search(hard.limit(0), items).count() == 0 and lexical.search(hard, items.limit(0)).count() == 0


def test_search_in_passes_and_small_blocks(spark, monkeypatch):
    """Many passes and trees give what one gives."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(lexical, "PASS_TERMS", 900)
    queries = lexical.term_queries(items).select("pass").distinct().count()
    assert queries > 1
    assert rows(lexical.search(docs, items)) == oracle("op11_ranked_lexical_search", documents=docs, benchmark=items)


def test_blocks_hold_every_row_once():
    rng = random.Random(0)
    rows = [(i, rng.randrange(1, 60)) for i in range(300)]
    table = pa.table({"doc_id": [i for i, _ in rows], "n": [n for _, n in rows], "terms": [list(range(n)) for _, n in rows], "times": [[i + 1] * n for i, n in rows]})
    old = lexical.BLOCK_DOCS, lexical.BLOCK_ENTRIES
    lexical.BLOCK_DOCS, lexical.BLOCK_ENTRIES = 40, 500
    try:
        got = []
        for ids, n, starts, terms, times in lexical._blocks(iter(table.to_batches(max_chunksize=70))):
            assert len(ids) <= 40 and (starts[-1] <= 500 or len(ids) == 1)
            for k, i in enumerate(ids):
                assert terms[starts[k] : starts[k + 1]].tolist() == list(range(n[k])) and set(times[starts[k] : starts[k + 1]].tolist()) == {i + 1}
                got.append((i, int(n[k])))
        assert got == rows
    finally:
        lexical.BLOCK_DOCS, lexical.BLOCK_ENTRIES = old


def test_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(3)
    vectors = [np.unique(rng.choice(400, 12) // (1 + k % 3)) for k in range(1500)]
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    terms, values = np.concatenate(vectors), rng.integers(1, 10**6, starts[-1])
    weights = rng.integers(0, 9000, 400)
    tree, leaves = lexical.Tree(starts, terms, values, weights), 0
    for _ in range(30):
        own, best = np.unique(rng.choice(400, 6)), []
        before = tree.scored
        tree.search(own, weights[own], best, list(range(1500)), 10)
        leaves += tree.scored - before
        w = np.zeros(400, dtype=np.int64)
        w[own] = weights[own]
        scores = np.add.reduceat(w[terms] * values, starts[:-1])
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want
    assert leaves < 30 * sum(n[2] < 0 for n in tree.nodes)


def test_position_table_gives_crc32():
    rng = random.Random(1)
    texts = [None, "", "Aé x" * 3, "x" * 200_000, "ab" * 32 + " " + "cd" * 33 + " " + "é" * 70 + "-" + "z" * 63, "中文" * 5000 + " ok", "a", "b"]
    texts += ["".join(rng.choice("aZ09 é-☃") for _ in range(rng.randrange(500))) for _ in range(50)]
    want = [[zlib.crc32(w.encode()) % 10_000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for t in texts]
    for stretch in (1000, 1 << 20):
        old, resampling.STRETCH = resampling.STRETCH, stretch
        try:
            got, counts = resampling.word_buckets(pa.array(texts))
        finally:
            resampling.STRETCH = old
        assert counts.tolist() == [len(x) for x in want] and got.tolist() == [b for x in want for b in x]


def test_resampling_on_hard_rows(spark, hard, items):
    for docs, target in ((hard, items), (hard.limit(0), items), (hard, items.limit(0)), (hard.unionByName(hard).unionByName(hard), items)):
        assert rows(resampling.resample(docs, target)) == oracle("op13_importance_resampling", documents=docs, benchmark=target)


def brute(vectors, every=100, top=10):
    """(query, score, id) of each query row's nearest rows."""
    out = []
    for i, (q, v) in enumerate(vectors):
        if q is not None and q % every == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), d is None, d or 0) for j, (d, w) in enumerate(vectors) if j != i and len(w) == len(v))
            out += [(q, s, None if m else d) for s, m, d in near[:top]]
    return out


def test_nearest_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = set(brute([(r["vec_id"], r["embedding"]) for r in table.collect() if r["embedding"] and any(r["embedding"])]))
    got = QUERIES["op12_nearest_neighbours"](spark, SF).collect()
    found = {(r["query_id"], r["score"], r["vec_id"]) for r in got}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)
    assert sorted((r["query_id"], r["rank"]) for r in got) == sorted((q, k + 1) for q in {r["query_id"] for r in got} for k in range(10))


def test_nearest_over_several_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    vectors = [(i, (centres[i % 30] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(6000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert nearest.build_index(df)[1].select("shard").distinct().count() == 3
    found = {(r["query_id"], r["score"], r["vec_id"]) for r in nearest.nearest(df).collect()}
    want = set(brute(vectors))
    assert len(found & want) >= 0.9 * len(want)


def test_nearest_on_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 2.0]) for i in range(100, 140)]
    good = [*same, (0, [1.0, 2.0]), (0, [1.0, 2.5]), (200, [3.0, 3.0]), (201, [1.0, 2.5]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (300, [1.0]), (301, [2.0]), (400, [5.0, 5.0, 5.0]), (500, [1e200, 1.0])]
    bad = [(600, None), (700, []), (800, [0.0, 0.0]), (900, [1.0, None]), (1000, [nan, 1.0]), (1100, [inf, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in good + bad], "vec_id long, embedding array<double>, row string, dim int, shard int")
    with np.errstate(over="ignore"):
        want = sorted(brute(good), key=str)
    got = sorted(((r["query_id"], r["score"], r["vec_id"]) for r in nearest.nearest(df).collect()), key=str)
    assert got == want
    assert nearest.nearest(df.limit(0)).count() == 0
