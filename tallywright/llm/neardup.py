"""MinHash near-duplicates by one-permutation hashing.

1.  Each document's distinct five-word shingles are hashed. Equal sets form classes; the smallest id stands for one.
2.  One permutation: a hash's high bits choose a bin, the smallest hash of a bin is its value; empty bins take the
    value of a full bin found by a fixed random search (optimal densification), so that two sets agree in a bin
    with a chance equal to their similarity, and bins of small sets stay nearly independent.
3.  Bins are banded. Documents without company in any bucket are done. For the others the shingle counts of the
    candidates give an exact bound: a document whose shingles occur, to less than the threshold's part, in any
    other candidate cannot be linked and goes.
4.  The rest is linked in stars: each bucket's members with its smallest node. Star edges are confirmed on full sets.
5.  Stars alone could miss a pair neither of whose ends is a centre. In each candidate group (connected by buckets)
    that still holds several components, a few rounds of stars follow round its most common sets, those with the
    smallest share of shingles that no other candidate has: the base of a family of copies is one.
6.  Where a group still holds several components, its sets are compared block against block of at most BLOCK sets,
    blocks of one and the same component left out: every pair of different components that could reach the
    threshold is confirmed on full sets, so no link is lost to a star's centre.
7.  Components take the smallest id of their sets' documents.

With 44 bands of 7 bins a pair at the threshold of 0.85 is missed by all buckets with a chance of 4 in 10**8, a
more similar one with less; at 0.8 the chance is 3 in 10**5. Linked are pairs with 100 * intersection >= percent *
union, 85 unless another number is given.

Nodes are sets, not ids: rows of one id with different texts are linked each by its own text, and rows with the same
set are one node, whatever their ids. A node is named by 64 bits of its set. Sets are told apart by 128 bits and their
size; where the names of two meet, as those of some three pairs in 10**10 sets do, all but one are named anew. Null texts and texts without words have no shingles, are linked with nothing and stand for
themselves. Rows with a null id are kept out of the linking: component_id is null and ``kept`` false. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, saved, small_join, written
from .shingles import mix, shingle_sets

PERCENT = 85
ROWS = 7
BANDS = 44
BINS = ROWS * BANDS
#: Sets of a block in step 6.
BLOCK = 512
#: Rounds of stars in step 5.
HUBS = 3
#: Bits of a node's first name.
NAME_BITS = 64

_SEARCH = 4096


def least_size(percent: int) -> int:
    """Below this many shingles only equal sets reach the threshold: n / (n + 1) is under it."""
    return -(-percent // (100 - percent))


_steps = np.arange(_SEARCH, dtype=np.uint64)[:, None]
_ORDER = (mix(mix(np.arange(BINS, dtype=np.uint64)[None, :] + np.uint64(1)) + _steps * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each non-empty sorted set."""
    out = np.zeros((len(sets), BINS), dtype=np.uint64)
    full = np.zeros((len(sets), BINS), dtype=bool)
    for i, s in enumerate(sets):
        bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out[i, bins[first]] = s[first]
        full[i, bins[first]] = True
    empty_rows = np.flatnonzero(~full.all(axis=1))
    own, have = out[empty_rows], full[empty_rows]
    filled, values = have.copy(), own.copy()
    left = np.arange(len(own))
    for step in range(_SEARCH):
        if not len(left):
            break
        source = _ORDER[step]
        usable = ~filled[left] & have[left][:, source]
        rows, columns = np.nonzero(usable)
        values[left[rows], columns] = own[left[rows], source[columns]]
        filled[left[rows], columns] = True
        left = left[~filled[left].all(axis=1)]
    for i in left:  # a search that long finds nothing with a chance below 10**-5 for six full bins; take the next full one
        gaps = np.flatnonzero(~filled[i])
        there = np.flatnonzero(have[i])
        values[i, gaps] = own[i, there[np.searchsorted(there, gaps) % len(there)]]
    out[empty_rows] = values
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS bucket keys for each set; the band's number is part of the key."""
    s = mix(signatures(sets)).reshape(len(sets), BANDS, ROWS)
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((s * weights).sum(axis=2, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))).astype(np.int64)


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def sketched(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_key (names the set of shingles), node (the same in 64 bits), bands (null where only equal sets can be linked)."""
    bits = NAME_BITS

    def work(part: pa.Table) -> dict[str, list]:
        sets = list(shingle_sets(_encoded(part["text"].to_pylist())))
        sums = _sums(sets)
        large = [i for i, s in enumerate(sets) if len(s) >= least_size(percent)]
        found: list = [None] * len(sets)
        for a in range(0, len(large), 512):
            own = large[a : a + 512]
            for i, row in zip(own, bands([sets[i] for i in own]), strict=True):
                found[i] = row
        return {"doc_id": part["doc_id"].to_pylist(), "n_shingles": [len(s) for s in sets], "set_key": _keys(sums), "node": _nodes(sums, bits), "bands": found}

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, n_shingles long, set_key string, node long, bands array<long>", work)


def _sums(sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
    return [(len(s), int(s.sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64))) for s in sets]


def _keys(sums: list[tuple[int, int, int]]) -> list[str]:
    return [f"{n}-{x:x}-{y:x}" for n, x, y in sums]


def _nodes(sums: list[tuple[int, int, int]], bits: int) -> np.ndarray:
    n, x, y = (np.array([s[k] for s in sums], dtype=np.uint64) for k in range(3))
    return (mix(mix(mix(n + np.uint64(0x51)) ^ x) ^ y) >> np.uint64(64 - bits)).astype(np.int64)


def shingled(docs: DataFrame) -> DataFrame:
    """set_key, node, shingles (sorted, distinct) of documents with a text."""
    bits = NAME_BITS

    def work(part: pa.Table) -> dict[str, list]:
        sets = list(shingle_sets(_encoded(part["text"].to_pylist())))
        sums = _sums(sets)
        return {"set_key": _keys(sums), "node": _nodes(sums, bits), "shingles": [s.astype(np.int64) for s in sets]}

    return map_texts(docs.select(F.col("text").cast("string")), "set_key string, node long, shingles array<long>", work)


def _met(classes: DataFrame) -> DataFrame | None:
    """set_key, _node: new names for the sets (set_key, node, one row each) whose name another set with a smaller key has; None without any."""
    shared = saved(classes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node"))
    if shared.isEmpty():
        return None
    met = small_join(classes.select("set_key", "node"), shared, ["node"])
    first = met.groupBy("node").agg(F.min("set_key").alias("_first"))
    return saved(met.join(first, "node").filter("set_key <> _first").select("set_key", F.xxhash64("set_key", "node").alias("_node")))


def _named(rows: DataFrame, met: DataFrame | None) -> DataFrame:
    """Rows (set_key, node, ...) under the nodes' final names."""
    if met is None:
        return rows
    return small_join(rows, met, ["set_key"], "left").withColumn("node", F.coalesce("_node", "node")).drop("_node")


def components(edges: DataFrame) -> DataFrame:
    """id, root of every end of an edge (a, b): the smallest id that it is connected with.

    Each round takes the smallest root among neighbours and then the root's root, so paths halve. Rounds are cut
    by checkpoints; only a count comes to the driver.
    """
    both = written(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct())
    state = both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("root"))
    state = written(state)
    while True:
        near = both.join(state.select(F.col("id").alias("to"), F.col("root").alias("r")), "to").groupBy("id").agg(F.min("r").alias("r"))
        better = state.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = state.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step = written(better.join(jump, "root", "left").select("id", "was", F.least("root", F.coalesce("up", "root")).alias("root")))
        if step.filter("root <> was").isEmpty():
            return step.select("id", "root")
        state = step.select("id", "root")


def _buckets(members: DataFrame) -> DataFrame:
    """Star edges a < b: the members (id, bands) of a bucket with its smallest."""
    keyed = members.select("id", F.explode("bands").alias("key"))
    stars = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("key", "a")
    return small_join(keyed, stars, ["key"]).filter("id > a").select("a", F.col("id").alias("b")).distinct()


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose full sets reach the threshold."""
    left = edges.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    full = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    bound = F.least(F.size("x"), F.size("y")) * 100 >= percent * F.greatest(F.size("x"), F.size("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return full.filter(bound).filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _links(ids: np.ndarray, roots: np.ndarray, lone: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between different components among the sets of a pair of blocks, no more than join them up.

    ``side`` tells the blocks apart: with two of them only pairs across count. ``lone`` counts a set's shingles that
    no other candidate has: they bound what a pair can share.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(inverse, kind="stable")
    posting = owner[order]
    begin = np.searchsorted(inverse[order], np.arange(len(values) + 1))
    spans = np.split(inverse, np.cumsum(sizes)[:-1])
    label = np.unique(roots, return_inverse=True)[1]
    common = sizes - lone
    single = len(np.unique(side)) == 1
    found = []
    for i in range(n):
        possible = label != label[i]
        if not single:
            possible &= side != side[i]
        possible &= 100 * np.minimum(common, common[i]) >= percent * np.maximum(sizes + lone[i], sizes[i] + lone)
        possible[: i + 1] = False
        if not possible.any():
            continue
        own = spans[i]
        counts = np.bincount(np.concatenate([posting[begin[v] : begin[v + 1]] for v in own]), minlength=n)
        for j in np.flatnonzero(possible & (100 * counts >= percent * (sizes + sizes[i] - counts))):
            if label[j] != label[i]:
                found.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return found


def _open(state: DataFrame) -> DataFrame:
    """The members (id, grp, root, ...) of the groups that hold several components."""
    groups = state.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("grp")
    return small_join(state, groups, ["grp"], "left_semi")


def _hub_links(state: DataFrame, sets: DataFrame, percent: int, done: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Confirmed links of one round of stars, and the hubs so far: each open group's most common set that was none yet, with the group's sets of other components."""
    own = state if done is None else state.join(done, "id", "left_anti")
    hubs = saved(own.groupBy("grp").agg(F.min(F.struct((F.col("lone") / F.col("n")).alias("share"), "id", "root")).alias("hub")).select("grp", F.col("hub.id").alias("a"), F.col("hub.root").alias("_root")))
    edges = small_join(state.select("id", "grp", "root"), hubs, ["grp"]).filter("root <> _root").select("a", F.col("id").alias("b"))
    centres = hubs.select(F.col("a").alias("id"))
    return saved(_confirmed(edges, sets, percent)), centres if done is None else done.unionByName(centres)


def _within_groups(state: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) inside groups (id, grp, root, lone) that hold several components.

    A component of more than BLOCK sets has blocks of its own; the others share blocks by hash. Each pair of blocks,
    but for those of one and the same component, is one task's group, of about 2 * BLOCK sets.
    """
    sizes = state.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("_size"))
    shared = F.when(F.col("_size") > BLOCK, F.col("root"))
    placed = saved(state.join(sizes, ["grp", "root"]).withColumn("_own", shared))
    counts = placed.groupBy("grp", "_own").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_nb"))
    listed = counts.select("grp", "_own", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_part"))
    numbers = saved(listed.withColumn("_block", F.row_number().over(Window.partitionBy("grp").orderBy("_own", "_part"))))
    x = numbers.select("grp", F.col("_own").alias("_x"), F.col("_block").alias("i"))
    y = numbers.select("grp", F.col("_own").alias("_y"), F.col("_block").alias("j"))
    pairs = x.join(y, "grp").filter((F.col("i") <= F.col("j")) & F.coalesce(F.col("_x") != F.col("_y"), F.lit(True))).select("grp", "i", "j")
    sided = pairs.select("grp", "i", "j", F.col("i").alias("_block"), F.lit(0).alias("side")).unionByName(pairs.filter("i < j").select("grp", "i", "j", F.col("j").alias("_block"), F.lit(1).alias("side")))
    spots = numbers.join(counts, (numbers["grp"] == counts["grp"]) & numbers["_own"].eqNullSafe(counts["_own"])).select(numbers["grp"], numbers["_own"], "_part", "_block", "_nb")
    part = F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int")
    size_of = counts.select(F.col("grp").alias("_g"), F.col("_own").alias("_o"), "_nb")
    dealt = placed.join(size_of, (F.col("grp") == F.col("_g")) & F.col("_own").eqNullSafe(F.col("_o"))).withColumn("_part", part).select("id", "grp", "root", "lone", "_own", "_part")
    spots = spots.select(F.col("grp").alias("_g"), F.col("_own").alias("_o"), F.col("_part").alias("_p"), "_block")
    members = dealt.join(spots, (F.col("grp") == F.col("_g")) & F.col("_own").eqNullSafe(F.col("_o")) & (F.col("_part") == F.col("_p"))).select("id", "grp", "root", "lone", "_block")
    loaded = members.join(sided, ["grp", "_block"]).join(sets, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _links(pdf["id"].to_numpy(), pdf["root"].to_numpy(), pdf["lone"].to_numpy(), [np.asarray(s, dtype=np.int64) for s in pdf["shingles"]], pdf["side"].to_numpy(), percent)
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    return loaded.select("id", "grp", "root", "lone", "i", "j", "side", "shingles").groupBy("grp", "i", "j").applyInPandas(compare, "a long, b long")


def _between(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs a < b of different components that edges (a, b) of nodes connect, once each; nodes without a root (id, root) are their own."""
    ends = [roots.select(F.col("id").alias(x), F.col("root").alias(f"_{x}")) for x in "ab"]
    a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    both = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").filter(a != b)
    return both.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _merged(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """roots (id, root) after the components (a, b) of ``pairs`` became one: only components are gone through, not their links again."""
    further = components(pairs).select(F.col("id").alias("root"), F.col("root").alias("_to"))
    moved = roots.join(further, "root", "left").select("id", F.coalesce("_to", "root").alias("root"))
    alone = further.join(roots.select("root"), "root", "left_anti").select(F.col("root").alias("id"), F.col("_to").alias("root"))
    return written(moved.unionByName(alone))


def _linked(heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id, root of the nodes that are linked with others. heads: id, bands; sets: id, shingles of the candidates."""
    single = sets.select("id", F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    bounded = sets.select("id", F.size("shingles").alias("n")).join(single, "id", "left").select("id", "n", F.coalesce("lone", F.lit(0)).alias("lone"))
    able = saved(bounded.filter(100 * (F.col("n") - F.col("lone")) >= percent * F.col("n")))
    members = saved(heads.join(able.select("id"), "id"))
    own_sets = saved(sets.join(able.select("id"), "id", "left_semi"))

    edges = saved(_buckets(members))
    roots = components(saved(_confirmed(edges, own_sets, percent)))
    # Candidate groups that hold several components are connected by what is left between those.
    left = saved(_between(edges, roots))
    if left.isEmpty():
        return roots
    groups = components(left).select(F.col("id").alias("root"), F.col("root").alias("grp"))
    state = able.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(groups, "root")
    state, done = saved(state.select("id", "grp", "n", "lone", "root")), None
    for _ in range(HUBS):
        if state.isEmpty():
            return roots
        more, done = _hub_links(state, own_sets, percent, done)
        if more.isEmpty():
            continue
        roots = _merged(roots, _between(more, roots))
        state = saved(_open(saved(state.drop("root").join(roots, "id", "left").select("id", "grp", "n", "lone", F.coalesce("root", "id").alias("root")))))
    if state.isEmpty():
        return roots
    more = saved(_within_groups(state, own_sets, percent))
    return roots if more.isEmpty() else _merged(roots, _between(more, roots))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document, linked from ``percent`` of similarity on."""
    every = saved(sketched(docs, percent))
    sketches = every.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = saved(sketches.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("node").alias("node")))
    met = _met(classes)
    classes = _named(classes, met)
    # Bands are the set's own: any row of a node has the same.
    heads = saved(_named(sketches.filter("bands IS NOT NULL"), met).select(F.col("node").alias("id"), "bands").dropDuplicates(["id"]))

    keyed = heads.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    candidates = saved(keyed.join(shared, "key", "left_semi").select("id").distinct())
    n = candidates.count()
    wanted = small_join(classes, candidates.select(F.col("id").alias("node")), ["node"], "left_semi", rows=n).select(F.col("rep").alias("doc_id")).distinct()
    texts = small_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, ["doc_id"], "left_semi", rows=n)
    sets = _named(shingled(texts), met).select(F.col("node").alias("id"), "shingles")
    sets = saved(sets.dropDuplicates(["id"]).join(candidates, "id", "left_semi"))
    roots = _linked(heads, sets, percent)

    # Classes whose nodes are linked share a component; its id is the smallest of its documents.
    linked = saved(classes.join(roots.select(F.col("id").alias("node"), "root"), "node"))
    named = small_join(linked, linked.groupBy("root").agg(F.min("rep").alias("component_id")), ["root"]).select("set_key", "component_id")
    component = classes.join(named, "set_key", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    known = sketches.select("doc_id", "n_shingles", "set_key").join(component, "set_key").select("doc_id", "n_shingles", "component_id")
    rest = every.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
