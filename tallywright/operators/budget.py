"""Token and execution budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import running_sum
from .blocks import BLOCK_ROWS, fold_by_blocks

ADMISSION = "allowed boolean, remaining_tokens long, remaining_executions long, response_status string, table_status string"


def _admit(state: tuple[int, int, str], row: tuple) -> tuple[tuple[int, int, str], tuple]:
    tokens, executions, status = state
    use, runs = row[0], row[1]
    if use is None or runs is None or use < 0 or runs < 0:
        return state, (False, tokens, executions, "rejected", status)
    if tokens - use >= 0 and executions - runs >= 0:
        tokens, executions = tokens - use, executions - runs
        return (tokens, executions, status), (True, tokens, executions, "active", status)
    return (tokens, executions, "exhausted"), (False, tokens, executions, "exhausted", "exhausted")


def meter(requests: DataFrame, order: list[str], tokens: int = 1_000_000, executions: int = 10_000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Admission in order per tenant (W09): a request runs if tokens and executions both stay at 0 or above; a denied one
    consumes nothing, so a later smaller one may run. The table's status sticks at exhausted; the response's does not.
    Negative and null amounts are rejected and change nothing. Start balances are the defaults, or the columns start_tokens and start_executions
    (constant within a tenant, the defaults where null) where the requests have them. Amounts count as whole numbers.
    A tenant's requests are settled in blocks (see :mod:`.blocks`), so a large tenant is many tasks.
    """
    rows = requests
    for i, (name, value) in enumerate((("start_tokens", tokens), ("start_executions", executions)), 1):
        given = F.col(name).cast("long") if name in requests.columns else F.lit(None).cast("long")
        rows = rows.withColumn(f"_start{i}", F.coalesce(given, F.lit(value).cast("long")))
    rows = rows.withColumns({"_use1": F.col("tokens_used").cast("long"), "_use2": F.col("executions_used").cast("long")})
    rows = rows.withColumn("_counts", F.coalesce((F.col("_use1") >= 0) & (F.col("_use2") >= 0), F.lit(False)))
    done = fold_by_blocks(rows, order, ["_use1", "_use2"], _admit, ADMISSION, block_rows)
    return done.drop("_use1", "_use2", "_start1", "_start2", "_counts")


def final_budgets(metered: DataFrame, order: list[str]) -> DataFrame:
    """Each tenant's balance after its last request, and its denials."""
    last = F.struct(*order)
    return metered.groupBy("tenant_id").agg(F.max_by("remaining_tokens", last).alias("token_balance"), F.max_by("remaining_executions", last).alias("executions_left"), F.max_by("table_status", last).alias("status"), F.count_if(~F.col("allowed")).alias("denials"))


def _draw(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    left, other, status = state
    if left is None:
        return state, (None, "no budget")
    if row[0] is None:
        return state, (left, "no amount")
    if row[0] > left:
        return state, (left, "insufficient budget")
    return (left - row[0], other, status), (left - row[0], None)


def draw_down(requests: DataFrame, budgets: DataFrame, order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Tokens alone, with what remains after each request; more than remains, no amount or no budget is an error row.

    A negative amount gives back. Settled in blocks as :func:`meter`.
    """
    starts = budgets.select("tenant_id", F.col("token_balance").cast("long").alias("_start1"))
    rows = requests.join(starts, "tenant_id", "left").withColumns({"_use1": F.col("tokens_used").cast("long"), "_use2": F.lit(0).cast("long"), "_start2": F.lit(0).cast("long")})
    rows = rows.withColumn("_counts", F.col("_use1").isNotNull())
    done = fold_by_blocks(rows, order, ["_use1"], _draw, "remaining_after long, error string", block_rows)
    return done.drop("_use1", "_use2", "_start1", "_start2", "_counts")


def running_spend(ledger: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Tokens spent so far, null amounts counting as 0, and their share of the limit (W11). No task sees a whole tenant: see :func:`running_sum`."""
    summed = running_sum(ledger.withColumn("_use", F.coalesce("tokens_used", F.lit(0))), ["tenant_id"], order, "_use", "spent").drop("_use")
    return summed.withColumn("share", F.round(F.col("spent") / F.lit(limit), 6))


def ledger_rollup(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Totals for every prefix of ``by``."""
    return ledger.rollup(*by).agg(F.sum("tokens_used").alias("tokens"), F.sum("executions_used").alias("executions"), F.count(F.lit(1)).alias("entries"), F.grouping_id().alias("level"))
