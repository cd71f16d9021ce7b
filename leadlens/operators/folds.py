"""Folds over ordered rows of a key, taken in time ranges.

Rows are dealt by ranges of (key, time), so a hot key's lie in many tasks. Each
task folds its rows in order, in bounded memory, to one summary a key; the few
summaries of a key (one a task at most) are combined in time order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summaries(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], add: Callable[[object, pa.RecordBatch], object], finish: Callable[[object], dict], schema: str) -> DataFrame:
    """(key, blocks): the summaries of each key's ranges in order, a struct each: the range's place, then ``schema``."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.taskcontext import TaskContext

        place = TaskContext.get().partitionId()  # ranges ascend with the partitions
        held, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key": held[0], "place": place} | finish(state)], schema=target)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if held is None or held[0] != keys[a]:
                    if held is not None:
                        yield out()
                    held, state = (keys[a],), start()
                state = add(state, batch.slice(a, b - a))
        if held is not None:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_schema

    full = f"key {kind}, place int, {schema}"
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], full).schema)
    names = [f.name for f in target][1:]
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(key, *[c for c in rows.columns if c != key])
    return dealt.mapInArrow(run, full).groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("blocks"))


def doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as float64; null as NaN."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.float64()).to_numpy(zero_copy_only=False)
