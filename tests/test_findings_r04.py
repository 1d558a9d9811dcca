"""Cases of the review's fourth round."""

import datetime
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tallywright.operators import chain, temporal
from tallywright.streaming import jobs


def test_as_recorded_takes_large_order_keys(spark, tmp_path):
    """Orders of the asked day count whatever their key; the later key decides between orders at one time, and only there."""
    from tallywright.plans.queries import AT, QUERIES

    at = datetime.datetime.fromisoformat(AT)
    day, moment = datetime.timedelta(days=1), datetime.timedelta(seconds=2)
    rows = [(5_000_000, 1, at), (4, 1, at - day), (9_000_001, 2, at), (9_000_000, 2, at), (6_000_000, 3, at + day), (7_000_000, 3, at - moment), (8, 3, at), (9, 4, at + day)]
    orders = spark.createDataFrame([(k, c, "O", 1.0, t, "1-URGENT") for k, c, t in rows], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["id"]: r["version"] for r in QUERIES["b04_as_recorded"](spark, str(tmp_path)).collect()}
    assert got == {1: 5_000_000, 2: 9_000_001, 3: 8}


def test_as_recorded_breaks_ties_by_the_columns_given(spark):
    writes = spark.createDataFrame([("t", 1, 5, v) for v in range(20)] + [("t", 1, 4, 99)], "tenant_id string, id long, updated_at long, version long")
    assert [r["version"] for r in temporal.as_recorded(writes.repartition(4), F.lit(5), ["version"]).collect()] == [19]


def _expiring(spark, tmp_path, log="log"):
    """Writes decisions (tenant, id, status, expiry, order) and a tick as files, and runs the stream over what is new; the log of changes, and its query."""
    kept, out = "tenant_id string, id long, status string, valid_to timestamp, updated_at timestamp", str(tmp_path / "out")

    def run(rows=(), tick=None):
        if rows:
            made = spark.createDataFrame(rows, "tenant_id string, id long, status string, v long, u long")
            made.selectExpr("tenant_id", "id", "status", "timestamp_seconds(v) AS valid_to", "timestamp_seconds(u) AS updated_at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if tick is not None:
            spark.range(1).selectExpr(f"timestamp_seconds({tick}) AS at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        read = lambda schema, place: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{place}")
        query = jobs.stream_expire(read(kept, "in"), read("at timestamp", "ticks"), out, str(tmp_path / log))
        changes = jobs.finished(query, spark, out)
        return [(r["tenant_id"], r["id"], r["version"], r["status"], r["updated_at"] and r["updated_at"].timestamp()) for r in changes.collect()], query

    return run


def test_expiry_goes_through_tables_of_buckets(spark, tmp_path):
    """No state a key in Python: a batch writes the buckets that it touches, a tick at which nothing is due none; a log read anew gives the same."""
    run, held = _expiring(spark, tmp_path), lambda k: [x for x in os.listdir(tmp_path / f"out-held/batch={k}") if x.startswith("_bucket")]
    rows = [("a", k, "draft", 100 + k, 1) for k in range(300)]
    got, query = run(rows, 99)
    assert not any(p["stateOperators"] for p in query.recentProgress) and sorted(got) == [("a", k, 1, "draft", 1) for k in range(300)]
    assert len(held(0)) > 50
    got, _ = run([("a", 7, "approved", 500, 2)], 100)
    assert len(held(1)) == 1 and ("a", 7, 2, "approved", 2) in got
    run((), 100)
    assert held(2) == []
    got, _ = run((), 250)
    want = {("a", k, 1, "draft", 1) for k in range(300)} | {("a", 7, 2, "approved", 2)} | {("a", k, 2, "stale", 250) for k in range(150) if k != 7}
    assert set(got) == want and len(got) == len(want)
    want |= {("a", k, 2, "stale", 600) for k in range(150, 300)} | {("a", 7, 3, "stale", 600)}
    assert set(run((), 600)[0]) == want
    again, _ = _expiring(spark, tmp_path, "again")()  # a fresh log: batches come again under their numbers
    assert set(again) == want and len(again) == len(want)


def test_expiry_of_odd_rows(spark, tmp_path):
    """Null keys, several versions of a key in a batch, tenants with one id, an expiry that is over on arrival, final ones, and one that comes back."""
    run = _expiring(spark, tmp_path)
    got, _ = run([("a", 1, "approved", 900, 5), ("a", 1, "draft", 10, None), ("a", 1, "draft", 20, 3), ("b", 1, "draft", 30, 1), (None, None, "draft", 40, 1), ("c", 2, "executed", 5, 1), ("c", 3, None, 5, 1), ("c", 4, "draft", None, 1)], 60)
    assert sorted(got, key=str) == sorted([("a", 1, 1, "draft", None), ("a", 1, 2, "draft", 3), ("a", 1, 3, "approved", 5), ("b", 1, 1, "draft", 1), ("b", 1, 2, "stale", 60), (None, None, 1, "draft", 1), (None, None, 2, "stale", 60), ("c", 2, 1, "executed", 1), ("c", 3, 1, None, 1), ("c", 3, 2, "stale", 60), ("c", 4, 1, "draft", 1)], key=str)
    late, _ = run([("b", 1, "draft", 50, 70), ("d", 1, "draft", 1, 70)])
    assert {r for r in late if r[:2] in (("b", 1), ("d", 1))} == {("b", 1, 1, "draft", 1), ("b", 1, 2, "stale", 60), ("b", 1, 3, "draft", 70), ("b", 1, 4, "stale", 60), ("d", 1, 1, "draft", 70), ("d", 1, 2, "stale", 60)}


@pytest.mark.parametrize("band", [2, 10])
def test_tree_proofs_are_not_shuffled(spark, monkeypatch, band):
    """Proofs over several bands of levels are those of the tree, for all writes and for a few; no row a level of each is made."""
    monkeypatch.setattr(chain, "BAND", band)
    sizes = {"t": 2500, "u": 1024, "v": 1, "w": 5}
    rows = spark.createDataFrame([(t, i, hashlib.sha256(f"{t}{i}".encode()).hexdigest(), i + 1) for t, n in sizes.items() for i in range(n)] + [(None, 1, "x", 1)], "tenant_id string, id long, leaf_hash string, height long").repartition(4)
    want = {}
    for t, n in sizes.items():
        level, paths = [hashlib.sha256(f"leaf|{hashlib.sha256(f'{t}{i}'.encode()).hexdigest()}".encode()).hexdigest() for i in range(n)], [[] for _ in range(n)]
        at = list(range(n))
        while len(level) > 1:
            for i, p in enumerate(at):
                if p ^ 1 < len(level):
                    paths[i].append((p % 2 == 1, level[p ^ 1]))
            at = [p // 2 for p in at]
            level = [hashlib.sha256(f"node|{a}{b[0]}".encode()).hexdigest() if b else a for a, *b in (level[k : k + 2] for k in range(0, len(level), 2))]
        want |= {(t, i): paths[i] for i in range(n)}
    tree = chain.hash_tree(rows)
    proofs = chain.tree_proofs(rows, tree, rows)
    assert "Generate" not in proofs._jdf.queryExecution().executedPlan().toString()
    read = lambda found: [((r["tenant_id"], r["id"]), [tuple(p) for p in r["proof"]]) for r in found.collect()]
    got = read(proofs)
    assert dict(got) == want and len(got) == len(want)
    few = rows.filter("id % 97 = 3").select("tenant_id", "id")
    some = read(chain.tree_proofs(rows, tree, few.unionByName(few)))
    assert dict(some) == {k: p for k, p in want.items() if k[1] % 97 == 3} and len(some) == len(dict(some))
    checked = chain.verify_tree_proofs(proofs, chain.tree_roots(tree))
    assert checked.columns == ["tenant_id", "id", "leaf_hash", "height", "proof", "tree_root", "included"]
    assert checked.filter("included").count() == len(want)
