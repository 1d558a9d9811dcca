"""Hash chains per tenant: build, verify, audit, proofs, snapshots, evidence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..common import BROADCAST_BYTES, byte_size, small_join, written
from ..functions.scalars import GENESIS, chain_hash, snapshot_hash
from ..sources.tables import insert_ignore
from .filters import latest_snapshot
from .fold import ordered_fold


def _extend(state: tuple[str, int], row: tuple) -> tuple[tuple[str, int], tuple[str, str, int]]:
    parent, height = state
    root = hashlib.sha256((parent + (row[0] or "")).encode()).hexdigest()
    return (root, height + 1), (parent, root, height + 1)


def chain(writes: DataFrame, order: list[str], leaf: str = "leaf_hash") -> DataFrame:
    """The log of writes with parent_root, root_hash and height of each (W02). A decision saved twice has two leaves."""
    return ordered_fold(writes, ["tenant_id"], order, [leaf], lambda _: (GENESIS, 0), _extend, "parent_root string, root_hash string, height long")


def chain_roots(chained: DataFrame) -> DataFrame:
    """Root and height per tenant."""
    return chained.groupBy("tenant_id").agg(F.max_by("root_hash", "height").alias("root_hash"), F.max("height").alias("height"))


def genesis(tenants: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots, with the first state for tenants without a chain."""
    fresh = tenants.select("tenant_id").distinct().select("tenant_id", F.lit(GENESIS).alias("root_hash"), F.lit(0).cast("long").alias("height"))
    return insert_ignore(roots.select("tenant_id", "root_hash", "height"), fresh, ["tenant_id"])


def verify_links(chained: DataFrame, leaf: str = "leaf_hash") -> DataFrame:
    """is_verified: both hashes are there; link_ok: the root follows from parent and leaf. No shuffle."""
    there = (F.coalesce(F.col("parent_root"), F.lit("")) != "") & (F.coalesce(F.col("root_hash"), F.lit("")) != "")
    return chained.withColumn("is_verified", there).withColumn("link_ok", F.coalesce(chain_hash(F.col("parent_root"), F.col(leaf)) == F.col("root_hash"), F.lit(False)))


def audit_chain(chained: DataFrame, recomputed_leaf: Column | None = None, leaf: str = "leaf_hash") -> DataFrame:
    """Per tenant: writes, whether the chain is whole, and the first break with its reason.

    Each write is joined with the one at the height before it, so no task sees a tenant's chain. A write follows on
    what the height before has as its root ("parent": another root, or none there) and stands alone at its own ("height").
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("tenant_id").cast("string")), F.lit("*"))
    checked = verify_links(chained, leaf).withColumn("_key", key)
    before = checked.groupBy("_key", (F.col("height") + 1).alias("height")).agg(F.min("root_hash").alias("_prev"))
    alone = checked.groupBy("_key", "height").agg(F.count(F.lit(1)).alias("_n"))
    joined = checked.join(before, ["_key", "height"], "left").join(alone, ["_key", "height"], "left")
    previous = F.when(F.col("height") == 1, F.lit(GENESIS)).otherwise(F.col("_prev"))
    reason = F.when(F.lit(False) if recomputed_leaf is None else ~(recomputed_leaf.eqNullSafe(F.col(leaf))), "leaf").when(~F.col("link_ok"), "link").when(~F.col("parent_root").eqNullSafe(previous), "parent").when((F.col("_n") > 1) | (F.col("height") < 1), "height")
    marked = joined.withColumn("_reason", reason)
    broken = F.when(F.col("_reason").isNotNull(), F.col("height"))
    return marked.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("writes"), F.min(broken).isNull().alias("chain_valid"), F.min(broken).alias("first_break"), F.min_by("_reason", broken).alias("reason"))


def _node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("node|"), left, right), 256)


def _leaf(leaf: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf|"), F.coalesce(leaf, F.lit(""))), 256)


def hash_tree(chained: DataFrame, leaf: str = "leaf_hash") -> DataFrame:
    """(tenant_id, level, pos, hash): a hash tree over each tenant's leaves in the order of their heights, beside the chain.

    Built level by level: two neighbours become one node, one without a neighbour goes up as it is. Leaves and nodes are
    hashed with different words before them, so neither passes for the other. A level is one small aggregate; there are
    as many as the longest chain's length has binary digits.
    """
    level, levels = written(chained.select("tenant_id", F.lit(0).alias("level"), (F.col("height") - 1).alias("pos"), _leaf(F.col(leaf)).alias("hash")), "zstd"), []
    while True:
        levels.append(level)
        if level.filter("pos > 0").isEmpty():
            return reduce(DataFrame.unionByName, levels)
        pair = level.groupBy("tenant_id", (F.col("level") + 1).alias("level"), F.shiftright("pos", 1).alias("pos"))
        both = pair.agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("hash"))).alias("_l"), F.max(F.when(F.col("pos") % 2 == 1, F.col("hash"))).alias("_r"))
        level = written(both.select("tenant_id", "level", "pos", F.coalesce(_node(F.col("_l"), F.col("_r")), "_l").alias("hash")), "zstd")


def tree_roots(tree: DataFrame) -> DataFrame:
    """tenant_id and the hash at the top of its tree."""
    return tree.filter("pos = 0").groupBy("tenant_id").agg(F.max_by("hash", "level").alias("tree_root"))


#: Levels of a tree that are read at once for proofs: blocks of 1,024 neighbours and the nodes above them.
BAND = 10
_PROOF = ArrayType(StructType().add("left", "boolean").add("hash", "string"))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by tenant_id and _block, dealt so that no block is in two tables, and the number of each row's block in its table."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        rows = rows.combine_chunks()
        if len(rows) < 2:
            rest = rows
            continue
        tenant, block = rows["tenant_id"], rows["_block"]
        other = pc.or_(pc.not_equal(tenant[1:], tenant[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        number = np.concatenate([[0], np.cumsum(other)]).astype(np.int64)
        end = int(np.searchsorted(number, number[-1]))
        if end:
            yield rows.slice(0, end), number[:end]
        rest = rows.slice(end)
    if rest is not None and len(rest):
        yield rest, np.zeros(len(rest), np.int64)


def _band_proofs(nodes: DataFrame, wanted: DataFrame, above: DataFrame | None) -> DataFrame:
    """``wanted`` (tenant_id, _at, ...) with ``proof``: its siblings among ``nodes`` (tenant_id, _k, _at, _hash), levels 0 to BAND - 1, then what ``above`` has for its block.

    Nodes and asked rows of a block meet in one task, a block at a time; a proof is made there and not shuffled.
    """
    own = [f for f in wanted.schema if f.name != "_block"]
    asked = wanted.withColumns({"_block": F.shiftright("_at", BAND), "_k": F.lit(BAND)})
    if byte_size(blocks := asked.select("tenant_id", "_block").distinct()) <= BROADCAST_BYTES:
        nodes = nodes.join(F.broadcast(blocks), ["tenant_id", "_block"], "left_semi")
    rows = nodes.unionByName(asked, allowMissingColumns=True)
    rows = rows.withColumn("_above", F.lit(None).cast(_PROOF)) if above is None else rows.unionByName(above.withColumn("_k", F.lit(-1)), allowMissingColumns=True)
    schema = StructType([*own]).add("_below", _PROOF).add("_above", _PROOF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in _whole_blocks(batches):
            k, at = table["_k"].to_numpy(), table["_at"].fill_null(0).to_numpy()
            ask = np.flatnonzero(k == BAND)
            if not len(ask):
                continue
            node, over = np.flatnonzero((k >= 0) & (k < BAND)), np.flatnonzero(k < 0)
            place = lambda n, level, pos: ((n * BAND + level) << BAND) | (pos & ((1 << (BAND - level)) - 1))
            have = place(number[node], k[node].astype(np.int64), at[node])  # ascending, as rows are sorted
            up = at[ask][:, None] >> np.arange(BAND)
            want = place(number[ask][:, None], np.arange(BAND)[None, :], up ^ 1)
            found = np.searchsorted(have, want)
            there = np.zeros(want.shape, bool) if not len(have) else have[np.minimum(found, len(have) - 1)] == want
            hashes = pa.array([h and h.hex() for h in table["_hash"].take(node).to_pylist()], pa.string())
            ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array((up & 1 == 1)[there]), hashes.take(pa.array(found[there]))], ["left", "hash"])
            near = np.searchsorted(number[over], number[ask])
            hit = np.isin(number[ask], number[over])
            far = table["_above"].combine_chunks().take(pa.array(over)).take(pa.array(near, pa.int64(), mask=~hit))
            out = table.select([f.name for f in own]).take(pa.array(ask))
            out = out.append_column("_below", pa.ListArray.from_arrays(ends, items)).append_column("_above", far)
            yield from out.combine_chunks().to_batches(max_chunksize=4096)

    dealt = rows.repartition("tenant_id", "_block").sortWithinPartitions("tenant_id", "_block", "_k", "_at")
    return dealt.mapInArrow(run, schema).withColumn("proof", F.concat("_below", F.coalesce("_above", F.array().cast(_PROOF)))).drop("_below", "_above")


def tree_proofs(chained: DataFrame, tree: DataFrame, asked: DataFrame, id_col: str = "id", leaf: str = "leaf_hash") -> DataFrame:
    """(tenant_id, id, leaf_hash, height, proof) of each asked (tenant_id, id): its siblings from the leaf up, with the side they stand on.

    A proof has one hash a level at most, so about log2 of the chain's length. The tree is gone down by bands of levels: a
    block's proofs from there up are known, and are carried on to all below it. So the tree and what is asked are shuffled
    once, not a row a level of each proof.
    """
    if asked is chained:
        own = chained.filter(F.col("tenant_id").isNotNull() & F.col(id_col).isNotNull())
    else:
        own = chained.join(asked.select("tenant_id", id_col).distinct(), ["tenant_id", id_col], "left_semi")
    own = own.select("tenant_id", id_col, F.col(leaf).alias("leaf_hash"), "height", (F.col("height") - 1).cast("long").alias("_at"))
    top, above = tree.agg(F.max("level")).first()[0] or 0, None
    for base in reversed(range(0, max(top, 1), BAND)):
        band = tree.filter((F.col("level") >= base) & (F.col("level") < base + BAND)).withColumn("_k", F.col("level") - base)
        nodes = band.select("tenant_id", F.expr(f"shiftright(pos, {BAND} - _k)").alias("_block"), "_k", F.col("pos").alias("_at"), F.unhex("hash").alias("_hash"))
        wanted = own if not base else own.select("tenant_id", F.shiftright("_at", base).alias("_at")).distinct()
        proofs = _band_proofs(nodes, wanted, above)
        above = proofs.select("tenant_id", F.col("_at").alias("_block"), F.col("proof").alias("_above"))
    return proofs.select("tenant_id", id_col, "leaf_hash", "height", "proof")


def verify_tree_proofs(proofs: DataFrame, roots: DataFrame) -> DataFrame:
    """proofs with ``included``: whether leaf and siblings fold to the tenant's root. Needs no other row of the tree."""
    folded = F.aggregate("proof", _leaf(F.col("leaf_hash")), lambda h, p: F.when(p["left"], _node(p["hash"], h)).otherwise(_node(h, p["hash"])))
    joined = small_join(proofs.withColumn("_folded", folded), roots.select("tenant_id", "tree_root"), ["tenant_id"], "left")
    return joined.withColumn("included", F.coalesce(F.col("_folded") == F.col("tree_root"), F.lit(False))).drop("_folded")


def inclusion_proof(chained: DataFrame, ids: list, id_col: str = "id", leaf: str = "leaf_hash") -> DataFrame:
    """For each asked write its parent root and the later leaves, and whether folding them gives the tenant's root.

    A proof is the rest of the chain by construction: it is folded in order by :func:`ordered_fold`, one leaf at a
    time, so no row holds it. Ask for few ids: each asked one reads what its tenant wrote after it.
    """
    asked = chained.filter(F.col(id_col).isin(ids)).select("tenant_id", F.col(id_col).alias("_id"), F.col("parent_root").alias("_parent"), F.col(leaf).alias("_leaf"), F.col("height").alias("_h"))
    later = chained.select("tenant_id", "height", F.col(leaf).alias("_l"), F.col("root_hash").alias("_r"))
    joined = small_join(later, asked, ["tenant_id"]).filter(F.col("height") >= F.col("_h"))

    def step(state: tuple, row: tuple) -> tuple:
        parent, leaf_, root = row
        now = hashlib.sha256(((state[0] if state else parent or "") + (leaf_ or "")).encode()).hexdigest()
        return (now,), (now == root,)

    folded = ordered_fold(joined, ["tenant_id", "_id"], ["height"], ["_parent", "_l", "_r"], lambda _: (), step, "_ok boolean")
    first = folded.groupBy("tenant_id", F.col("_id").alias(id_col)).agg(F.first("_leaf").alias("leaf_hash"), F.first("_parent").alias("parent_root"), F.first("_h").alias("height"), F.max_by("_r", "height").alias("root_hash"), (F.count(F.lit(1)) - 1).alias("proof_length"), F.max_by("_ok", "height").alias("included"))
    return first.select("tenant_id", id_col, "leaf_hash", "parent_root", "height", "root_hash", "proof_length", "included")


def proofs(chained: DataFrame, roots: DataFrame, leaf: str = "leaf_hash") -> DataFrame:
    """Each write with its tenant's current root and height."""
    current = roots.select("tenant_id", F.col("root_hash").alias("tenant_root"), F.col("height").alias("tenant_height"))
    return verify_links(chained, leaf).join(current, "tenant_id")


def evidence_chain(blocks: DataFrame) -> DataFrame:
    """prev_hash of every evidence block: the hash before it in its decision, or 64 zeros (W07). ``evidence_hash`` is the payload's own."""
    by = Window.partitionBy("tenant_id", "decision_id").orderBy("created_at", "id")
    hashed = blocks.withColumn("evidence_hash", F.sha2(F.coalesce("payload", F.lit("")), 256))
    return hashed.withColumn("prev_hash", F.lag("evidence_hash", 1, "0" * 64).over(by))


def latest_evidence(blocks: DataFrame) -> DataFrame:
    """The last block of every decision."""
    return blocks.groupBy("tenant_id", "decision_id").agg(F.max_by("evidence_hash", F.struct("created_at", "id")).alias("evidence_hash"), F.max_by("id", F.struct("created_at", "id")).alias("id"))


def roots_by_window(chained: DataFrame, ts: str, every: str) -> DataFrame:
    """The last root and height of each tenant in each tumbling window: the input of snapshots."""
    return chained.groupBy("tenant_id", F.window(ts, every).alias("w")).agg(F.max_by("root_hash", "height").alias("root_hash"), F.max("height").alias("block_height")).select("tenant_id", F.col("w.end").alias("epoch_timestamp"), "root_hash", "block_height")


def _snap(state: str, row: tuple) -> tuple[str, tuple[str, str]]:
    tenant, root, height, epoch = row
    made = hashlib.sha256("|".join([str(tenant), root, str(height), state, str(epoch)]).encode()).hexdigest()
    return made, (state, made)


def snapshot_chain(epochs: DataFrame) -> DataFrame:
    """Snapshots over a tenant's epochs, each over the hash of the one before; the first over '' (W08). An unchanged root makes a new snapshot."""
    rows = epochs.withColumn("epoch_unix", F.unix_timestamp("epoch_timestamp"))
    return ordered_fold(rows, ["tenant_id"], ["epoch_unix"], ["tenant_id", "root_hash", "block_height", "epoch_unix"], lambda _: "", _snap, "parent_snapshot_hash string, snapshot_hash string")


def snapshot_step(roots: DataFrame, snapshots: DataFrame, epoch: Column) -> DataFrame:
    """One further snapshot of every tenant: its root joined with its latest snapshot."""
    last = latest_snapshot(snapshots).select("tenant_id", F.col("snapshot_hash").alias("_p"))
    parent = F.coalesce(F.col("_p"), F.lit(""))
    unix = F.unix_timestamp(epoch)
    return roots.join(last, "tenant_id", "left").select("tenant_id", "root_hash", F.col("height").alias("block_height"), parent.alias("parent_snapshot_hash"), snapshot_hash(F.col("tenant_id"), F.col("root_hash"), F.col("height"), parent, unix).alias("snapshot_hash"), unix.alias("epoch_unix"))
