"""Approximate nearest neighbours by Euclidean distance: a robust-pruned directed graph in each shard.

Rows are dealt at random to shards. A shard's vectors enter its graph in growing batches: a greedy search from the
vector nearest the mean proposes neighbours, pruning keeps a candidate unless one kept before is nearer to it by a
factor, and edges back are added under the same pruning. Each query beam-searches each shard; distances of what the
beams hold are worked out anew in double precision, and the shards' lists are merged.

Exact copies within a shard are one vertex that lists all its rows, so a group of copies takes no edges; every row is
in an index. Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different
lengths are never compared. Repeated ids are rows of their own (a query leaves out its own row alone); a null vec_id
comes last among equal distances. An empty table gives an empty result. Other columns are not read.

What may be missed: neighbours that no beam reaches. Recall against brute force is measured in the tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, saved, small_join, written

TOP = 10
QUERY_EVERY = 100
#: Edges of a vertex, beams while building and searching, and the pruning factor.
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 24, 40, 56, 1.2
#: A table is dealt to about so many shards as long as they have LEAST_ROWS rows, and none more than MOST_ROWS rows or MOST_NUMBERS components.
SHARDS, LEAST_ROWS, MOST_ROWS, MOST_NUMBERS = 24, 2048, 65_536, 1 << 22
#: Queries that meet a shard at once; vectors that are searched together in a task.
QUERY_BLOCK, BATCH = 65_536, 256


def _beam(x: np.ndarray, squares: np.ndarray, graph: np.ndarray, entry: int, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids in the beams, nearest first; ids that were expanded, in order). -1 fills up."""
    n = len(asked)
    ids, far, done = np.full((n, width), -1), np.full((n, width), np.inf, dtype=np.float32), np.zeros((n, width), dtype=bool)
    ids[:, 0], far[:, 0] = entry, squares[entry] - 2 * (asked @ x[entry])
    path = []
    while True:
        open_ = ~done & (ids >= 0)
        live = np.flatnonzero(open_.any(axis=1))
        if not len(live):
            return ids, np.stack(path, axis=1)
        slot = open_[live].argmax(axis=1)
        now = ids[live, slot]
        done[live, slot] = True
        step = np.full(n, -1)
        step[live] = now
        path.append(step)
        near = graph[now]
        apart = squares[near] - 2 * np.matmul(x[near], asked[live][:, :, None])[:, :, 0]
        held = ids[live]
        apart[(near < 0) | (near[:, :, None] == held[:, None, :]).any(axis=2)] = np.inf
        every, dist = np.concatenate([held, near], axis=1), np.concatenate([far[live], apart], axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        far[live] = np.take_along_axis(dist, order, axis=1)
        ids[live] = np.where(np.isinf(far[live]), -1, np.take_along_axis(every, order, axis=1))
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, dtype=bool)], axis=1), order, axis=1)


def _prune(x: np.ndarray, squares: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Robust pruning for each point: the nearest candidate stays and removes all that it is nearer to, by the factor, than the point is."""
    candidates = np.sort(candidates, axis=1)
    bad = (candidates < 0) | (candidates == points[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    apart = np.maximum(squares[candidates] - 2 * np.matmul(x[candidates], x[points][:, :, None])[:, :, 0] + squares[points][:, None], 0)
    apart[bad] = np.inf
    order = np.argsort(apart, axis=1, kind="stable")
    candidates, apart = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(apart, order, axis=1)
    vectors, own = x[candidates], squares[candidates]
    between = own[:, :, None] + own[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive, rows = np.isfinite(apart), np.arange(len(points))
    out = np.full((len(points), degree), -1)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, k] = candidates[rows[some], first[some]]
        alive &= relax * relax * between[rows, first] > apart
        alive[rows, first] = False
    return out


def _add_back(x: np.ndarray, squares: np.ndarray, graph: np.ndarray, points: np.ndarray, degree: int, relax: float) -> None:
    """Edges back to ``points`` from where their edges go; a vertex with too many edges is pruned."""
    to, source = graph[points].ravel(), np.repeat(points, graph.shape[1])
    to, source = to[to >= 0], source[to >= 0]
    while len(to):
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        heads = np.flatnonzero(np.diff(to, prepend=-1))
        place = np.arange(len(to)) - np.repeat(heads, np.diff(np.append(heads, len(to))))
        now = place < degree  # more edges to one vertex wait for the next round
        targets = to[heads]
        added = np.full((len(targets), degree), -1)
        added[np.searchsorted(targets, to[now]), place[now]] = source[now]
        for a in range(0, len(targets), BATCH):
            some = targets[a : a + BATCH]
            both = np.concatenate([graph[some], added[a : a + BATCH]], axis=1)
            full = (both >= 0).sum(axis=1) > degree
            roomy = np.sort(both[~full], axis=1)[:, ::-1][:, :degree]
            roomy[:, 1:][roomy[:, 1:] == roomy[:, :-1]] = -1
            graph[some[~full]] = roomy
            if full.any():
                graph[some[full]] = _prune(x, squares, some[full], both[full], degree, relax)
        to, source = to[~now], source[~now]


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """(neighbours of each vertex, filled up with -1; where searches enter) for different vectors."""
    x = _scaled(vectors)
    squares = np.einsum("ij,ij->i", x, x)
    centre = x.mean(axis=0, dtype=np.float64).astype(np.float32)
    entry = int((squares - 2 * (x @ centre)).argmin())
    graph = np.full((len(x), degree), -1)
    order = np.random.default_rng(0).permutation(len(x))
    order = order[order != entry]
    at = 0
    while at < len(order):
        points = order[at : at + min(BATCH, max(1, at))]
        at += len(points)
        _, path = _beam(x, squares, graph, entry, x[points], beam)
        graph[points] = _prune(x, squares, points, path, degree, relax)
        _add_back(x, squares, graph, points, degree, relax)
    return graph, entry


def _scaled(vectors: np.ndarray, by: float | None = None) -> np.ndarray:
    """Single precision for steering only; scaled, so that no square overflows."""
    most = np.abs(vectors).max(initial=0.0) if by is None else by
    return np.clip(vectors / (most or 1.0), -1e6, 1e6).astype(np.float32)


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


INDEX = "dim int, shard int, vertex int, entry boolean, vector array<double>, edges array<int>, ids array<bigint>, rows array<bigint>"
_RUN = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vertex", pa.int32()), ("entry", pa.bool_()), ("vector", pa.list_(pa.float64())), ("edges", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])


def _build(key: tuple, table: pa.Table) -> pa.Table:
    dim = key[0].as_py()
    vectors = _rows(table["vector"], dim)
    ids, rows = table["vec_id"].to_pylist(), table["row"].to_pylist()
    firsts, group = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)[1:]
    members: list[list] = [[] for _ in firsts]
    for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i])):
        members[group[i]].append(i)
    vectors = vectors[firsts]
    graph, entry = build_graph(vectors)
    n = len(vectors)
    offsets = pa.array(np.arange(n + 1) * dim, pa.int32())
    out = [
        pa.repeat(key[0], n).cast(pa.int32()), pa.repeat(key[1], n).cast(pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(np.arange(n) == entry),
        pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel())), pa.array([g[g >= 0].tolist() for g in graph], pa.list_(pa.int32())),
        pa.array([[ids[i] for i in m] for m in members], pa.list_(pa.int64())), pa.array([[rows[i] for i in m] for m in members], pa.list_(pa.int64())),
    ]
    release()
    return pa.Table.from_arrays(out, schema=_RUN)


FOUND = "q long, query_id long, vec_id long, score double"
_FOUND = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(top: int, beam: int):
    def search(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        if not index.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        index = index.sort_by("vertex")
        vectors, asked = _rows(index["vector"], dim), _rows(queries["vector"], dim)
        by = np.abs(vectors).max(initial=0.0)
        x, n = _scaled(vectors, by), len(vectors)
        squares = np.einsum("ij,ij->i", x, x)
        edges = index["edges"].combine_chunks()
        sizes = np.diff(edges.offsets.to_numpy())
        graph = np.full((n, max(1, int(sizes.max(initial=0)))), -1)
        graph[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = edges.flatten().to_numpy()
        entry = int(np.flatnonzero(index["entry"].to_numpy())[0])
        ids, rows = index["ids"].to_pylist(), index["rows"].to_pylist()
        own, names = queries["q"].to_pylist(), queries["query_id"].to_pylist()
        out: list[tuple] = []
        for a in range(0, len(asked), BATCH):
            exact = asked[a : a + BATCH]
            held, _ = _beam(x, squares, graph, entry, _scaled(exact, by), max(beam, top + 1))
            apart = np.sqrt(((vectors[held] - exact[:, None, :]) ** 2).sum(axis=2))
            apart[held < 0] = np.inf
            order = np.argsort(apart, axis=1, kind="stable")
            for i, places in enumerate(order.tolist()):
                got: list[tuple] = []
                for p in places:
                    v, score = held[i, p], apart[i, p]
                    if v < 0 or len(got) >= top and score > got[-1][0]:
                        break
                    other = [(score, d is None, d or 0, r) for d, r in zip(ids[v], rows[v], strict=True) if r != own[a + i]] if len(rows[v]) <= top else _first(score, ids[v], rows[v], own[a + i], top)
                    got += other
                out += [(own[a + i], names[a + i], None if missing else d, s) for s, missing, d, _ in sorted(got)[:top]]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        release()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return search


def _first(score: float, ids: list, rows: list, own: int, top: int) -> list[tuple]:
    """The first of a vertex's copies, which are sorted by id: no more than ``top`` can be in a list."""
    out = []
    for d, r in zip(ids, rows, strict=True):
        if r != own:
            out.append((score, d is None, d or 0, r))
            if len(out) == top:
                break
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), dim: the rows that take part."""
    v = F.col("vector")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(v.isNotNull() & finite & F.exists(v, lambda c: c != 0)).withColumn("dim", F.size(v))


def build_index(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that take part with their shard, the graphs as a table with a row for each vertex)."""
    rows = saved(usable(embeddings).withColumn("row", F.monotonically_increasing_id()))
    per_shard = F.greatest(F.lit(LEAST_ROWS), F.least(F.ceil(F.col("n") / SHARDS), F.lit(MOST_ROWS), F.floor(F.lit(MOST_NUMBERS) / F.col("dim"))))
    sizes = saved(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") / per_shard).cast("int").alias("shards")))
    dealt = small_join(rows, sizes, ["dim"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    index = written(dealt.groupBy("dim", "shard").applyInArrow(_build, INDEX))
    return dealt, index


def nearest(embeddings: DataFrame, top: int = TOP, every: int = QUERY_EVERY, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row whose vec_id is divisible by ``every``."""
    dealt, index = build_index(embeddings)
    asked = dealt.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.select("dim", F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "vector", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = graphs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(top, beam), FOUND)
    order = Window.partitionBy("q").orderBy("score", F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
