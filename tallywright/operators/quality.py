"""Data-quality checks (Q01-Q06): each returns the offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_ranges(df: DataFrame, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return df.filter(F.col(end).isNotNull() & (F.col(start) > F.col(end)))


def check_domains(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """Rows with a value outside of its column's list, with the column's name; nulls are left to check_not_null."""
    bad = [df.filter(~F.col(c).isin(values)).withColumn("column", F.lit(c)) for c, values in allowed.items()]
    return reduce(DataFrame.unionByName, bad)


def check_orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> DataFrame:
    """Rows whose non-null key is not in the parent table."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(child_keys, parent_keys, strict=True)]).distinct()
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_keys])
    return child.filter(there).join(keys, child_keys, "left_anti")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column, columns without any left out. One pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*").filter("n > 0")


def cascade(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str], mode: str = "cascade") -> DataFrame:
    """Referential clean-up: ``cascade`` drops rows without a parent, ``set_null`` empties the last key column (Q06)."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(child_keys, parent_keys, strict=True)]).distinct()
    last = child_keys[-1]
    if mode == "cascade":
        return child.filter(F.col(last).isNull()).unionByName(child.join(keys, child_keys, "left_semi").select(*child.columns))
    joined = child.join(keys.withColumn("_there", F.lit(True)), child_keys, "left")
    return joined.withColumn(last, F.when(F.col("_there"), F.col(last))).select(*child.columns)
