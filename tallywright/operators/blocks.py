"""Sequential budgets without a task a tenant: blocks of requests that are settled by a summary.

Rows are dealt by ranges of (tenant, order); a tenant's rows in a range are a block. Of a block only its sums, its largest
running sums and its least amounts matter as long as it fits whole into what is left, or none of it fits. So what is
left at the start of each block is found by going over summaries, a few rows a block; only the rows of blocks that
are neither are looked at one by one, and at most a few such blocks of a tenant meet in one task. Then each block is
folded from its known start, all of them side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import saved, written
from .fold import ordered_fold

#: Rows of a block, about.
BLOCK_ROWS = 50_000
#: Blocks of a tenant that are gone through row by row in one task at most.
TOGETHER = 16

#: What is left of two amounts, and a status: (first, second, status).
State = tuple
STATE = "_left1 long, _left2 long, _status string"


def tenant_key(column: str = "tenant_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("*"))


def _summaries(rows: DataFrame, order: list[str]) -> DataFrame:
    """A row a block: sums, largest running sums and least amounts of its requests that count (``_counts``), zero requests apart."""
    so_far = Window.partitionBy("_key", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.filter("_counts").withColumns({f"_run{i}": F.sum(f"_use{i}").over(so_far) for i in (1, 2)})
    moves = (F.col("_use1") != 0) | (F.col("_use2") != 0)
    least = {f"_least{i}": F.min(F.when(moves, F.col(f"_use{i}"))) for i in (1, 2)}
    found = sums.groupBy("_key", "_block").agg(*[F.sum(f"_use{i}").alias(f"_sum{i}") for i in (1, 2)], *[F.max(f"_run{i}").alias(f"_most{i}") for i in (1, 2)], *[c.alias(n) for n, c in least.items()], F.count_if(moves).alias("_moves"), F.count_if(~moves).alias("_zeros"), F.sum(F.greatest(-F.col("_use1"), F.lit(0))).alias("_given"))
    blocks = rows.groupBy("_key", "_block").agg(F.min("_start1").alias("_start1"), F.min("_start2").alias("_start2"))
    return blocks.join(found, ["_key", "_block"], "left")


_READ = ["_row", "_start1", "_start2", "_left1", "_left2", "_status", "_use1", "_use2", "_counts", "_sum1", "_sum2", "_most1", "_most2", "_least1", "_least2", "_moves", "_zeros"]


def _over_block(state: State, r: dict) -> State | None:
    """What is left after a block by its summary; None if only its rows can tell."""
    left1, left2, status = state
    if not r["_moves"] and not r["_zeros"]:
        return state
    if r["_most1"] <= left1 and r["_most2"] <= left2:
        return left1 - r["_sum1"], left2 - r["_sum2"], status
    if not r["_moves"]:  # zero requests alone, and a balance below zero: all are denied
        return left1, left2, "exhausted"
    if r["_least1"] > left1 or r["_least2"] > left2:
        return left1, left2, "exhausted"
    return None


def _step(state: tuple | None, values: tuple) -> tuple[tuple, tuple]:
    r = dict(zip(_READ, values, strict=True))
    if state is None:
        state = (r["_left1"], r["_left2"], r["_status"], False)
    *left, stopped = state
    before = (*left, stopped)
    if stopped or left[0] is None:
        return state, before
    if not r["_row"]:
        after = _over_block(tuple(left), r)
        return ((*left, True), (*left, True)) if after is None else ((*after, False), before)
    if r["_counts"]:
        fits = left[0] - r["_use1"] >= 0 and left[1] - r["_use2"] >= 0
        state = (left[0] - r["_use1"], left[1] - r["_use2"], left[2], False) if fits else (left[0], left[1], "exhausted", False)
    return state, before


def block_starts(rows: DataFrame, order: list[str], together: int = TOGETHER) -> DataFrame:
    """_key, _block, _left1, _left2, _status: what is left when each block begins.

    Rounds: each goes over a tenant's remaining summaries in one task, with the rows of the next ``together`` blocks
    that may be neither whole nor void; it ends at a further such block, where the next round goes on.
    """
    every = saved(_summaries(rows, order))
    first = Window.partitionBy("_key").orderBy("_block")
    blocks = every.withColumn("_n", F.row_number().over(first))
    known = written(blocks.filter("_n = 1").select("_key", "_block", F.col("_start1").alias("_left1"), F.col("_start2").alias("_left2"), F.lit("active").alias("_status")))
    several = blocks.groupBy("_key").agg(F.max("_n").alias("_of"), F.sum(F.coalesce("_given", F.lit(0))).alias("_gift")).filter("_of > 1")
    state = written(known.join(several.select("_key", "_gift"), "_key"))  # where each tenant of several blocks goes on
    parts = [known]
    while not state.isEmpty():
        rest = every.join(state.select("_key", F.col("_block").alias("_from"), "_left1", "_left2", "_status", "_gift"), "_key").filter(F.col("_block") >= F.col("_from"))
        # What can be left at most, as no request gives anything back but the negative ones.
        void = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_least{i}") > F.col(f"_left{i}") + (F.col("_gift") if i == 1 else F.lit(0)), F.lit(False)) for i in (1, 2)])
        before = first.rowsBetween(Window.unboundedPreceding, -1)
        whole = reduce(lambda a, b: a & b, [F.coalesce(F.sum(F.coalesce(f"_sum{i}", F.lit(0))).over(before), F.lit(0)) + F.coalesce(f"_most{i}", F.lit(0)) <= F.col(f"_left{i}") for i in (1, 2)])
        whole = F.coalesce(F.min(whole.cast("int")).over(first.rowsBetween(Window.unboundedPreceding, 0)) == 1, F.lit(True))  # without a budget no row matters
        marked = rest.withColumn("_whole", whole).withColumn("_open", ~(void | F.col("_whole") | F.col("_sum1").isNull()))
        marked = marked.withColumn("_rank", F.sum(F.col("_open").cast("int")).over(first)).withColumn("_rows", F.col("_open") & (F.col("_rank") <= together))
        marked = written(marked)
        summary = marked.filter("NOT _rows").withColumns({"_row": F.lit(False), "_use1": F.lit(0).cast("long"), "_use2": F.lit(0).cast("long"), "_counts": F.lit(False), "_order": F.lit(None).cast(_order_type(rows, order))})
        shown = marked.filter("_rows").drop("_start1", "_start2").join(rows.select("_key", "_block", "_use1", "_use2", "_counts", "_start1", "_start2", F.struct(*order).alias("_order")), ["_key", "_block"]).withColumn("_row", F.lit(True))
        names = ["_key", "_block", "_order", *_READ]
        items = summary.select(*names).unionByName(shown.select(*names))
        renamed = items.withColumnsRenamed({"_left1": "_l1", "_left2": "_l2", "_status": "_s"})
        read = [{"_left1": "_l1", "_left2": "_l2", "_status": "_s"}.get(c, c) for c in _READ]
        folded = ordered_fold(renamed, ["_key"], ["_block", "_order"], read, lambda _: None, _step, f"{STATE}, _stopped boolean")
        begun = written(folded.groupBy("_key", "_block").agg(F.min_by(F.struct("_left1", "_left2", "_status", "_stopped"), F.struct(F.col("_order").isNotNull(), "_order")).alias("_b")).select("_key", "_block", "_b.*"))
        parts.append(begun.filter("NOT _stopped").join(state.select("_key", F.col("_block")), ["_key", "_block"], "left_anti").select(*known.columns))
        stopped = begun.filter("_stopped").groupBy("_key").agg(F.min_by(F.struct("_block", "_left1", "_left2", "_status"), "_block").alias("_b")).select("_key", "_b.*")
        parts.append(stopped.select(*known.columns))
        state = written(stopped.join(several.select("_key", "_gift"), "_key"))
    return reduce(DataFrame.unionByName, parts)


def _order_type(rows: DataFrame, order: list[str]):
    return rows.select(F.struct(*order).alias("o")).schema["o"].dataType


def fold_by_blocks(rows: DataFrame, order: list[str], inputs: list[str], step: Callable, outputs: str, block_rows: int = BLOCK_ROWS, together: int = TOGETHER) -> DataFrame:
    """:func:`ordered_fold` over tenants for rules of budgets, block by block.

    ``rows`` has _use1, _use2, _counts (whether the request can change what is left) and _start1, _start2 (constant
    within a tenant). ``step`` takes a state (first, second, status) and the inputs.
    """
    kept = saved(rows.withColumn("_key", tenant_key()))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // block_rows))
    ranged = saved(kept.repartitionByRange(n, "_key", *order).withColumn("_block", F.spark_partition_id()))
    starts = saved(block_starts(ranged, order, together))
    whole = ranged.join(starts, ["_key", "_block"])

    def run(state, row):
        return step(row[-3:] if state is None else state, row[:-3])

    folded = ordered_fold(whole, ["_key", "_block"], order, [*inputs, "_left1", "_left2", "_status"], lambda _: None, run, outputs)
    return folded.drop("_key", "_block", "_left1", "_left2", "_status")
