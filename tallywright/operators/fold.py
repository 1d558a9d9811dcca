"""Ordered folds by key: the kernel of chains and budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[Any, tuple], tuple[Any, tuple]]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], init: Callable[[tuple], Any], step: Step, outputs: str) -> DataFrame:
    """Every row of ``df`` with what a sequential rule gives for it.

    Rows of a key go to one task, which sorts them on disk if need be and keeps the state of one key at a time. A
    key is sequential by definition (each state needs the one before), so the parallelism is across keys.
    ``init(key)`` makes a key's state; ``step(state, row of inputs)`` returns the next state and the row's outputs
    (DDL in ``outputs``). Null keys are a key of their own, and so is NaN. The rows' own columns pass through as
    they are; one with an output's name gives way to it.
    """
    extra = StructType.fromDDL(outputs)
    names = [f.name for f in extra]
    own = [c for c in df.columns if c not in names]
    schema = StructType([f for f in df.schema if f.name in own] + extra.fields)
    types = to_arrow_schema(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            made: list[tuple] = []
            places = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            for place, row in zip(places, zip(*[batch.column(c).to_pylist() for c in inputs], strict=True), strict=True):
                key = tuple("NaN" if x != x else x for x in place)
                if key != now:
                    now, state = key, init(key)
                state, out = step(state, row)
                made.append(out)
            results = [pa.array([m[i] for m in made], type=f.type) for i, f in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *results], names=[*own, *names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
