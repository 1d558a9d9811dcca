"""Ranked lexical search: every document against every query text, exactly.

A document is a sparse vector over the terms of the queries, a query one of integer term weights; the score is their
inner product. In each task documents go to blocks, each block to a ball tree: a node has the centroid of its documents,
their radius round it, and how far they reach beyond it along each term. No score below it exceeds centroid times query
plus radius times the query's length, nor centroid plus reach, times the query: a query has some thirty terms, and
a document differs from the centroid in all the others, so the second is mostly the nearer of the two bounds.
Trees are searched best-first; what lies under a bound below the tenth score so far is pruned, the rest is scored in integers.
Bounds are in doubles and widened by more than their rounding, so nothing is lost to it.

Texts: null and empty texts have no terms; such a document is in no list, such a query has none. Documents with a null
id come last among equal scores, repeated rows are rows of their own. Repeated queries are ranked each by itself. An
empty table on either side gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, map_texts, numbered, release, saved, small_batches, written

TOP = 10
#: Terms of the queries that are searched in one pass over the documents; an item with more is alone.
PASS_TERMS = 32_768
#: Documents of a tree, and entries of their vectors, at most (a longer vector is alone).
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 1_000_000
#: Documents of a leaf at most.
LEAF = 32
#: Bytes of a text that are cut into words at once.
STRETCH = 1 << 20
#: More than the relative error of a sum of positive doubles over any vector here.
ROUNDING = 1e-9

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms in order, in parts: a long text is cut between terms."""
    data, at = (text or b"").translate(_WORDS), 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH) if at + STRETCH < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_queries(items: DataFrame) -> DataFrame:
    """item (a number of its own), item_id, terms, pass: items with their distinct terms, dealt into passes."""

    def work(part: pa.Table) -> dict[str, list]:
        found = [sorted({t for some in terms_of(x) for t in some}) for x in part["text"].cast(pa.large_binary()).to_pylist()]
        return {"item_id": part["item_id"].to_pylist(), "terms": found}

    cut = map_texts(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "item_id long, terms array<binary>", work)
    rows = saved(cut.filter(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()))
    placed = numbered(rows.withColumn("_w", F.size("terms") + 16), [], F.xxhash64("item"), ["item"], rows.count(), "_before", "_w")
    return saved(placed.select("item", "item_id", "terms", F.floor(F.col("_before") / PASS_TERMS).cast("int").alias("pass")))


def projected(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (all terms of the text), terms (places in ``terms``), times (how often each stands in the text)."""
    place = {t: i for i, t in enumerate(terms)}

    def work(part: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": part["doc_id"].to_pylist(), "n": [], "terms": [], "times": []}
        for text in part["text"].cast(pa.large_binary()).to_pylist():
            n, counts = 0, {}
            for words in terms_of(text):
                n += len(words)
                for i in map(place.get, words):
                    if i is not None:
                        counts[i] = counts.get(i, 0) + 1
            out["n"].append(n)
            out["terms"].append(list(counts))
            out["times"].append(list(counts.values()))
        return out

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(own, "doc_id long, n long, terms array<int>, times array<long>", work)


class Tree:
    """A ball tree over sparse vectors: ``starts`` of the rows' entries, their ``terms`` and integer ``values``.

    Distances are of vectors scaled by the square roots of the term weights: a query then has these roots as its
    entries, and inner products stay the same.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray):
        self.used, local = np.unique(terms, return_inverse=True)
        scaled, n = values * np.sqrt(weights[terms].astype(float)), len(starts) - 1
        lengths = np.diff(starts)
        squares = np.add.reduceat(scaled * scaled, starts[:-1])
        order, todo, nodes = np.arange(n), [(0, n, -1)], []
        centroids, radii, reaches = [], [], []
        while todo:
            a, b, parent = todo.pop()
            rows = order[a:b]
            sizes = lengths[rows]
            begins = np.cumsum(sizes) - sizes
            entries = np.repeat(starts[:-1][rows] - begins, sizes) + np.arange(sizes.sum())
            at, x = local[entries], scaled[entries]
            centre = np.bincount(at, weights=x, minlength=len(self.used)) / (b - a)
            norm = float(centre @ centre)
            apart = squares[rows] - 2 * np.add.reduceat(x * centre[at], begins) + norm
            radii.append(math.sqrt(max(float((apart + ROUNDING * (squares[rows] + norm)).max()), 0.0)))
            by_term = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.diff(at[by_term], prepend=-1))
            beyond = np.zeros(len(centre))
            beyond[at[by_term[heads]]] = np.maximum.reduceat(x[by_term], heads)
            reaches.append(np.maximum(beyond - centre, 0))
            centroids.append(centre)
            me = len(nodes)
            nodes.append([a, b, -1, -1])
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = me
            if b - a > LEAF:
                far = int(apart.argmax())
                dense = np.zeros(len(self.used))
                span = slice(begins[far], begins[far] + sizes[far])
                dense[at[span]] = x[span]
                other = int((squares[rows] - 2 * np.add.reduceat(x * dense[at], begins)).argmax())
                span = slice(begins[other], begins[other] + sizes[other])
                np.subtract.at(dense, at[span], x[span])
                order[a:b] = rows[np.argsort(np.add.reduceat(x * dense[at], begins), kind="stable")]
                todo += [((a + b) // 2, b, me), (a, (a + b) // 2, me)]
        self.nodes, self.centroids, self.radii, self.reaches, self.order = nodes, np.array(centroids), np.array(radii), np.array(reaches), order
        sizes = lengths[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        entries = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.terms, self.values = local[entries], values[entries]
        self.scored = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], ids: list[int], k: int) -> None:
        """Brings the heap ``best`` of (score, -id) up to date with this tree's rows. ``terms`` are sorted, ``weights`` are theirs."""
        place = np.searchsorted(self.used, terms)
        here = (place < len(self.used)) & (self.used[np.minimum(place, len(self.used) - 1)] == terms)
        place, w = place[here], weights[here]
        if not len(place):
            return
        query = np.sqrt(w.astype(float))
        centre = self.centroids[:, place] @ query
        within = np.minimum(math.sqrt(float(w.sum())) * self.radii, self.reaches[:, place] @ query)
        bounds = (centre + within) * (1 + ROUNDING) + 1
        dense = np.zeros(len(self.used), dtype=np.int64)
        dense[place] = w
        todo = [(-bounds[0], 0)] if centre[0] > 0 else []  # a centroid without the query's terms has no document with one
        while todo:
            bound, node = heapq.heappop(todo)
            if len(best) == k and -bound < best[0][0]:
                break
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if centre[child] > 0 and (len(best) < k or bounds[child] >= best[0][0]):
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            self.scored += 1
            begin, end = self.starts[a], self.starts[b]
            scores = np.add.reduceat(dense[self.terms[begin:end]] * self.values[begin:end], self.starts[a:b] - begin)
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[i]), -ids[self.order[a + i]])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


#: Stands for a null id in the heaps: after every other id.
_NO_ID = 1 << 63


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, n, starts, terms, times) of rows with terms, BLOCK_DOCS rows or BLOCK_ENTRIES entries at a time."""
    parts, docs, entries = [], 0, 0

    def block():
        lengths = np.concatenate([p[2] for p in parts])
        return [i for p in parts for i in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])

    for batch in batches:
        terms, times = batch.column("terms"), batch.column("times")
        offsets = terms.offsets.to_numpy()
        flat, counts = terms.values.to_numpy(), times.values.to_numpy()
        shift = times.offsets.to_numpy()[0] - offsets[0]
        ids, n, at = batch.column("doc_id").to_pylist(), batch.column("n").to_numpy(), 0
        while at < batch.num_rows:
            end = min(batch.num_rows, at + BLOCK_DOCS - docs, int(np.searchsorted(offsets, offsets[at] + BLOCK_ENTRIES - entries, side="right")) - 1)
            end = max(end, at + (not docs))
            if end > at:
                a, b = offsets[at], offsets[end]
                parts.append((ids[at:end], n[at:end], np.diff(offsets[at : end + 1]), flat[a:b], counts[a + shift : b + shift]))
                docs, entries, at = docs + end - at, entries + int(b - a), end
            if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES or at < batch.num_rows:
                yield block()
                parts, docs, entries = [], 0, 0
    if parts:
        yield block()


def _pass(docs: DataFrame, queries: list, top: int) -> DataFrame:
    """item, doc_id, score: the best of each task for each of a pass's queries."""
    terms = sorted({bytes(t) for q in queries for t in q["terms"]})
    place = {t: i for i, t in enumerate(terms)}
    vectors = written(projected(docs, terms))
    n_docs, n_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(terms), dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a number for each term of the pass
        weights[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    asked = [(q["item"], np.sort(np.array([place[bytes(t)] for t in q["terms"]], dtype=np.int64))) for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {item: [] for item, _ in asked}
        for ids, n, starts, at, times in _blocks(batches):
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            values = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, np.diff(starts)))
            tree = Tree(starts, at, values, weights)
            ids = [_NO_ID if i is None else i for i in ids]
            for item, own in asked:
                tree.search(own, weights[own], best[item], ids, top)
        rows = [(item, None if -i == _NO_ID else -i, score) for item, held in best.items() for score, i in held]
        release()
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows[a : a + 10_000]], pa.int64()) for k, c in enumerate(("item", "doc_id", "score"))})

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its ``top`` documents with the highest scores above 0.

    Documents are read once for each PASS_TERMS terms of the items: their vectors over these terms are written, counted,
    and searched where they lie. Each task hands on at most ``top`` rows an item.
    """
    small_batches(docs.sparkSession)
    queries = term_queries(items)
    passes = [r[0] for r in queries.select("pass").distinct().collect()]
    found = None
    for p in sorted(passes):
        own = queries.filter(F.col("pass") == p).collect()  # at most PASS_TERMS terms, or one item's
        part = _pass(docs, own, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


_TERMS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"
SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
all_n AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, coalesce(sum(len(terms)), 0)::BIGINT AS total FROM d),
q AS (SELECT i, item_id, unnest(list_distinct(terms)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark)),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, all_n GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(terms)::BIGINT * docs) // total AS m FROM d, all_n WHERE len(terms) > 0),
s AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS p FROM s WHERE score > 0)
SELECT item_id, p::INT AS rank, doc_id, score FROM ranks WHERE p <= {TOP}
"""
