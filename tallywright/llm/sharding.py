"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents of equal text are linked. A group larger than a shard is split into parts of a shard's size; a part's links
are a tree of at most FAN children a node (a star, up to FAN + 1 documents), so no document has more neighbours than
that. Documents start in shards by hash, but for the roots, which start in even runs by the sizes of their parts. In
each round documents are joined with their neighbours: first those with a parent name its shard, in the next round
roots name the most common shard of their children. What one shard may send another is bounded by swaps and by free
room; the quotas are worked out from counts by pair of shards, a number fixed by the shards. Rounds end when no link
is cut, or nothing may move. Documents without links have no edge to cut: they fill each shard up to its quota, so
sizes are even at the end.

The law is ``rows``: every shard has the same number of documents, or one more. Null texts count as empty (size 16).
Repeated rows are documents of their own. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, small_join, written

SHARDS = 40
ROUNDS = 10
#: Children of a document in its part's tree at most.
FAN = 500


def quotas(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many may move from shard s (row) to shard t (column): swaps in pairs, then free room by demand. Counts stay within room whatever else happens."""
    swap = np.minimum(wanted, wanted.T)
    rest = wanted - swap
    allowed = swap.copy()
    for t in range(len(room)):
        free = int(room[t])
        for s in np.argsort(-rest[:, t], kind="stable"):
            give = min(free, int(rest[s, t]))
            allowed[s, t] += give
            free -= give
    return allowed


def edges(state: DataFrame) -> DataFrame:
    """The links, one row each: the documents with a parent (_uid, _part, _k, shard) and the parent's shard as _to."""
    return _with_parents(state).filter("_k > 0")


def _with_parents(state: DataFrame) -> DataFrame:
    """state with the parent's shard as _to; roots have their own."""
    parents = state.select("_part", F.col("_k").alias("_parent"), F.col("shard").alias("_up"))
    own = state.withColumn("_parent", F.when(F.col("_k") > 0, F.floor((F.col("_k") - 1) / FAN).cast("long")))
    return own.join(parents, ["_part", "_parent"], "left").select("_uid", "_part", "_k", "shard", F.coalesce("_up", "shard").alias("_to"))


def _with_children(state: DataFrame) -> DataFrame:
    """state with the most common shard of its children as _to for roots; the others have their own."""
    counts = state.filter((F.col("_k") > 0) & (F.col("_k") <= FAN)).groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("_part").agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("m")).select("_part", F.lit(0).cast("long").alias("_k"), (-F.col("m.s")).alias("_most"))
    return state.join(most, ["_part", "_k"], "left").select("_uid", "_part", "_k", "shard", F.coalesce("_most", "shard").alias("_to"))


def propagate(state: DataFrame, n_linked: int, caps: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """state: _uid, _part, _k, shard. Returns the same after the moves; no shard gets more than its cap."""
    k, idle = len(caps), 0
    for turn in range(rounds):
        moves = written(_with_children(state) if turn % 2 else _with_parents(state))
        counts = moves.groupBy("shard", "_to").agg(F.count(F.lit(1)).alias("n")).collect()  # at most SHARDS squared rows
        wanted, sizes = np.zeros((k, k), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for s, t, n in counts:
            sizes[s] += n
            wanted[s, t] = n if s != t else 0
        allowed = quotas(wanted, np.maximum(caps - sizes, 0))
        if not allowed.any():
            idle += 1
            if idle == 2 or turn == 0 and not wanted.any():
                break
            continue
        idle = 0
        quota = F.element_at(F.array(*[F.lit(int(x)) for x in allowed.ravel()]), (F.col("shard") * k + F.col("_to") + 1).cast("int"))
        movers = numbered(moves.filter("shard <> _to"), ["shard", "_to"], F.xxhash64("_part", F.pmod("_uid", F.lit(16))), ["_part", "_uid"], n_linked, "_turn")
        moved = movers.withColumn("shard", F.when(F.col("_turn") < quota, F.col("_to")).otherwise(F.col("shard"))).drop("_turn")
        state = written(moved.unionByName(moves.filter("shard = _to")).select("_uid", "_part", "_k", "shard"))
    return state


def _within(homes: DataFrame, caps: np.ndarray, n_linked: int) -> DataFrame:
    """The start may be above a cap by chance where nearly all documents are linked: what is over goes to where room is."""
    k = len(caps)
    sizes = np.zeros(k, dtype=np.int64)
    for s, n in homes.groupBy("shard").count().collect():  # at most SHARDS rows
        sizes[s] = n
    if (sizes <= caps).all():
        return homes
    ends = np.cumsum(np.maximum(caps - sizes, 0))
    cap = F.element_at(F.array(*[F.lit(int(c)) for c in caps]), (F.col("shard") + 1).cast("int"))
    turned = written(numbered(homes, ["shard"], F.xxhash64("_uid"), ["_uid"], n_linked, "_turn"))
    over = numbered(turned.filter(F.col("_turn") >= cap), [], F.xxhash64("_uid"), ["_uid"], n_linked, "_n")
    free = F.array(*[F.lit(int(e)) for e in ends])
    moved = over.select("_uid", F.size(F.filter(free, lambda e: e <= F.col("_n"))).alias("shard"))
    return moved.unionByName(turned.filter(F.col("_turn") < cap).select("_uid", "shard"))


def started(rows: DataFrame, groups: DataFrame, n_groups: int, n_linked: int, shards: int, part_rows: int) -> DataFrame:
    """_uid, _part, _k, shard of the linked documents before the first round. rows: _uid, _group; groups: _group, _of."""
    begins = numbered(groups, [], F.xxhash64("_group"), ["_group"], n_groups, "_begin", weight="_of").select("_group", "_begin")
    members = written(small_join(rows.select("_uid", "_group"), begins, ["_group"], rows=n_groups))
    placed = numbered(members, ["_group"], F.xxhash64("_uid"), ["_uid"], n_linked, "_n")
    part = F.concat_ws("-", "_group", F.floor(F.col("_n") / part_rows))
    parted = placed.select("_uid", part.alias("_part"), F.pmod("_n", F.lit(part_rows)).alias("_k"), (F.col("_begin") + F.col("_n")).alias("_at"))
    # By hash, in even numbers: a place in hash order, dealt round; roots by the place of their part among all.
    spread = numbered(parted, [], F.xxhash64("_uid", F.lit(7)), [F.xxhash64("_uid", F.lit(7)), "_uid"], n_linked, "_deal")
    root = F.floor(F.col("_at") * shards / max(n_linked, 1))
    return written(spread.select("_uid", "_part", "_k", F.when(F.col("_k") == 0, root).otherwise(F.pmod("_deal", F.lit(shards))).cast("int").alias("shard")))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("_group"))
    base = written(base)
    n = base.count()
    # A row's identity, so that repeated rows stay apart.
    rows = written(numbered(base, [], F.xxhash64("doc_id", "_group"), ["doc_id", "_group"], n, "_uid"))
    caps = np.full(shards, n // shards, dtype=np.int64)
    caps[: n % shards] += 1
    part_rows = max(2, n // shards)

    groups = written(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_of")).filter("_of > 1"))
    n_groups, n_linked = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("_of"), F.lit(0))).first()
    if n_linked:
        homes = propagate(started(rows, groups, n_groups, n_linked, shards, part_rows), n_linked, caps, rounds).select("_uid", "shard")
        homes = written(_within(homes, caps, n_linked))
    else:
        homes = rows.select("_uid", F.lit(0).alias("shard")).limit(0)
    used = dict(homes.groupBy("shard").count().collect())  # at most SHARDS rows

    # The rest fills the shards in turn up to their caps.
    single = small_join(rows, groups.select("_group"), ["_group"], "left_anti", rows=n_groups).select("_uid")
    ends = np.cumsum([int(caps[s]) - used.get(s, 0) for s in range(shards)])
    filled = numbered(single, [], F.xxhash64("_uid"), ["_uid"], n, "_k")
    ends_array = F.array(*[F.lit(int(e)) for e in ends])
    filled = filled.select("_uid", F.size(F.filter(ends_array, lambda e: e <= F.col("_k"))).alias("shard"))
    every = rows.join(filled.unionByName(homes), "_uid")
    slotted = numbered(every.select("doc_id", "size", "text_crc32", "_uid", "shard"), ["shard"], F.xxhash64("_uid"), ["_uid"], n, "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
