"""Mixing sources to target weights, in DataFrame functions alone.

The words of a source's documents stand in one stream (in an order by hash of the document id), cut into blocks of at
most BLOCK words, their lengths equal but for one word, so that slots times a source's mean block are its words to
within one word a slot. Blocks fill a grid of rows and columns, near a square: as few as that takes, which is at most
one row more than the words need. Output shards draw the sources of their slots at random, the counts of
a shard being multinomial; the shards come in waves, and each wave draws in proportion to what the sources still lack
of their targets. Slots of a source that has all it wants are drawn again, in shards of their own, until a thousandth
or less of all slots is left, or REDRAWS times. A source's slots are numbered, and a pseudorandom permutation of its
blocks, one for each pass over them, tells which block a slot holds. It is worked out for each slot alone, by rounds on
the place's row and column in the grid; slots and blocks are then joined by the block's index.

No block is drawn more than twice, so no document exceeds twice its size. Every random number is a hash of a
place and the seed: reruns agree. Null texts and texts without words have size 0, and nothing is taken of them.
A null source is a source of its own, last in order. Repeated rows are documents of their own. Empty tables give
empty results. One row per source is handled as a table that may be counted, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, saved, small_join

WEIGHTS = (5, 2, 1)
#: The mix holds this many times all words.
SHARE = 1.5
#: No source gives more than this many times its words.
PASSES = 2
#: Words of a block at most.
BLOCK = 32
#: Slots of an output shard.
SHARD_SLOTS = 256
#: Each wave takes two thirds of the shards that are left; the last takes them all.
WAVES = 4
#: So often at most what was drawn in vain is drawn again; it ends earlier with a thousandth or less left.
REDRAWS = 10
#: Rounds of the permutation: each shifts the row by a hash of the column, or the column by a hash of the row.
ROUNDS = 4
#: Cells of the table that maps random numbers to sources.
CELLS = 1024


def sized(docs: DataFrame, row: Column) -> DataFrame:
    """doc_id, _row, _source (struct, so that nulls join), size. White space is ASCII's."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.cast("long").alias("_row"), F.struct(F.col("source").cast("string").alias("s")).alias("_source"), words.cast("long").alias("size"))


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """_source, source_size, n_docs, target. Sources rank by code point, nulls last; weights repeat along the ranks.

    Targets are in proportion to the weights; those above ``passes`` times their source stop there and the rest
    share the excess by weight, until none is above. Each step needs three sums over the sources.
    """
    order = Window.orderBy(F.col("_source.s").isNull(), F.col("_source.s"))
    sums = docs.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(order) - 1
    sources = saved(sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))))
    limit = F.col("source_size") * float(passes)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = F.col("weight") * level >= limit
        row = sources.agg(F.sum(F.when(capped, limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(capped.cast("long"))).first()
        if not row[1] or row[2] == full:
            break
        level, full = (share * total - row[0]) / row[1], row[2]
    return sources.select("_source", "source_size", "n_docs", F.least(limit, F.col("weight") * level).alias("target"))


def _unit(*key: Column | str) -> Column:
    """A number in [0, 1) from a key's hash: 53 bits."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11)).cast("double") / float(1 << 53)


def _cells(need: DataFrame) -> DataFrame:
    """cell, lo, hi, _source: which source a number falls to, listed for each of CELLS equal parts of [0, 1)."""
    run = Window.orderBy(F.col("_source.s").isNull(), F.col("_source.s")).rowsBetween(Window.unboundedPreceding, 0)
    sums = need.filter("need > 0").withColumn("_hi", F.sum("need").over(run))
    total = F.max("_hi").over(Window.partitionBy())
    lo, hi = (F.col("_hi") - F.col("need")) / total, F.col("_hi") / total
    spans = sums.select("_source", lo.alias("lo"), F.when(F.col("_hi") == total, F.lit(1.0)).otherwise(hi).alias("hi"))
    return spans.select("*", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))


def permuted(df: DataFrame) -> DataFrame:
    """Adds ``to``: where ``index`` goes in a pseudorandom permutation of 0 .. rows * columns - 1, one for each ``key`` (columns of ``df``, long).

    Each round can be undone, as what it hashes it leaves unchanged: so no two numbers go to one place. A grid of one
    row has rotations alone. Rounds are projections of their own: in one expression each would hold the one before
    several times.
    """
    out = df.withColumn("_column", F.pmod("index", "columns")).withColumn("_row", F.floor((F.col("index") - F.col("_column")) / F.col("columns")))
    for r in range(ROUNDS):
        moved, fixed, size = ("_row", "_column", "rows") if r % 2 == 0 else ("_column", "_row", "columns")
        shift = F.pmod(F.xxhash64("key", F.lit(r), fixed), F.col(size))
        out = out.withColumn(moved, F.pmod(F.col(moved) + shift, F.col(size)))
    return out.withColumn("to", F.col("_row") * F.col("columns") + F.col("_column")).drop("_row", "_column")


def wanted(targets: DataFrame) -> DataFrame:
    """targets with rows, columns, n_blocks (their product), want (slots that give the target at the source's mean words a block) and room (the most slots it may have)."""
    least = F.ceil(F.col("source_size") / BLOCK)
    grid = targets.withColumn("rows", F.greatest(F.lit(1), F.floor(F.sqrt(least)))).withColumn("columns", F.ceil(least / F.col("rows")))
    n_blocks = F.col("rows") * F.col("columns")
    want = F.when(F.col("source_size") > 0, F.col("target") * n_blocks / F.col("source_size")).otherwise(0.0)
    out = grid.withColumn("n_blocks", n_blocks).withColumn("want", want)
    return out.withColumn("room", F.least(F.ceil("want"), PASSES * F.col("n_blocks")))


def draw(spark: SparkSession, targets: DataFrame, n_slots: int, seed: int) -> DataFrame:
    """shard, slot, _source of all slots; a source may have more than its room, and as many others are there in addition. ``targets`` has want and room."""
    drawn: DataFrame | None = None
    begin, left, need = 0, n_slots, targets.select("_source", F.col("want").alias("need"))
    for wave in range(WAVES + REDRAWS):
        shards = -(-left // SHARD_SLOTS)
        n = left if wave >= WAVES - 1 else min(left, -(-shards * 2 // 3) * SHARD_SLOTS)
        ids = spark.range(begin, begin + n)
        slots = ids.select((F.col("id") / SHARD_SLOTS).cast("long").alias("shard"), F.pmod("id", F.lit(SHARD_SLOTS)).alias("slot"), _unit(F.lit(seed), F.lit("source"), "id").alias("u"))
        own = slots.withColumn("cell", F.floor(F.col("u") * CELLS))
        hit = saved(small_join(own, _cells(need), ["cell"]).filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("shard", "slot", "_source"))
        drawn = hit if drawn is None else drawn.unionByName(hit)
        begin += -(-n // SHARD_SLOTS) * SHARD_SLOTS
        had = drawn.groupBy("_source").agg(F.count(F.lit(1)).alias("had"))
        state = saved(targets.join(had, "_source", "left").select("_source", "want", F.least("room", F.coalesce("had", F.lit(0))).alias("had")))
        need = state.select("_source", F.greatest(F.lit(0.0), F.col("want") - F.col("had")).alias("need"))
        row = state.agg(F.sum("had"), F.sum(F.greatest(F.lit(0.0), F.col("want") - F.col("had")))).first()
        left = n_slots - row[0]
        if left <= 0 or not row[1] or wave >= WAVES - 1 and 1000 * left <= n_slots:
            break
    return drawn


def mix(docs: DataFrame, seed: int = 0, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, and the column ``row`` if one is named that tells rows apart."""
    sizes = saved(sized(docs, F.col(row) if row else F.lit(None)))
    spark = docs.sparkSession
    targets = saved(wanted(source_targets(sizes)))
    n_docs, n_sources = sizes.count(), targets.count()
    known = small_join(sizes, targets.select("_source", "source_size", "target", "n_blocks"), ["_source"], rows=n_sources)
    slots_wanted = targets.agg(F.sum("want")).first()[0] or 0.0
    n_slots = max(1, int(slots_wanted + 0.5)) if slots_wanted else 0
    columns = ["doc_id", "size", "source_size", "target", *([F.col("_row").alias(row)] if row else [])]
    full = known.filter("size > 0")
    none = known.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    if not n_slots:
        return none.unionByName(full.select(*columns, F.lit(0).cast("long").alias("taken")))

    # Streams: where each document starts among its source's words, and which blocks it touches.
    at = saved(numbered(full, ["_source"], F.xxhash64(F.coalesce("doc_id", "_row"), F.lit(seed)), ["doc_id", "size", "_row"], n_docs, "start", weight="size"))
    # The first blocks of a source have one word more: ``long`` blocks of ``least`` + 1 words, then blocks of ``least``.
    least = F.floor(F.col("source_size") / F.col("n_blocks"))
    spans = at.withColumn("least", least).withColumn("long", F.col("source_size") - F.col("n_blocks") * F.col("least"))

    def block_of(word: Column) -> Column:
        edge = F.col("long") * (F.col("least") + 1)
        return F.when(word < edge, F.floor(word / (F.col("least") + 1))).otherwise(F.col("long") + F.floor((word - edge) / F.col("least")))

    def begin_of(block: Column) -> Column:
        return block * F.col("least") + F.least(block, F.col("long"))

    first, last = block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1)
    pieces = spans.select("_source", "start", "size", "least", "long", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("start") + F.col("size"), begin_of(F.col("block") + 1)) - F.greatest(F.col("start"), begin_of(F.col("block")))
    pieces = pieces.select("_source", "start", "block", words.alias("words"))

    # Slots of a source, numbered; passes over its blocks have permutations of their own.
    slots = draw(spark, targets, n_slots, seed)
    slots = numbered(slots, ["_source"], F.xxhash64("shard", "slot"), ["shard", "slot"], n_slots, "place")
    counts = targets.select("_source", "rows", "columns", "n_blocks", "room")
    slots = small_join(slots, counts, ["_source"], rows=n_sources).filter(F.col("place") < F.col("room"))
    turn, index = F.floor(F.col("place") / F.col("n_blocks")), F.pmod("place", F.col("n_blocks"))
    slots = slots.select("_source", "rows", "columns", index.alias("index"), F.xxhash64("_source", turn, F.lit(seed)).alias("key"))
    taken = permuted(slots).withColumnRenamed("to", "block").groupBy("_source", "block").agg(F.count(F.lit(1)).alias("times"))

    sums = pieces.join(taken, ["_source", "block"]).groupBy("_source", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = at.join(sums, ["_source", "start"], "left").select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out.unionByName(none)
