"""Folds over the rows of a group in order, for rules whose next step depends on their last one."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def folded(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], start: Callable[[], dict], step: Callable[[dict, tuple], Iterable[tuple]], out: str | StructType, finish: Callable[[tuple, dict], Iterable[tuple]] | None = None) -> DataFrame:
    """What step(state, row) gives for each row of a group, in order, and finish(key, state) at its end; a group begins with start().

    Spark deals the groups and sorts them (and spills, if need be); a task carries the small state from batch to
    batch, so no group is gathered.  Rows are tuples in the order of rows.columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = rows.sparkSession.createDataFrame([], out).schema if isinstance(out, str) else out
    arrow, names = to_arrow_schema(schema), rows.columns
    at = [names.index(c) for c in by]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        key, state = None, {}
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                now = tuple(row[k] for k in at)
                if now != key:
                    if finish and key is not None:
                        found.extend(finish(key, state))
                    key, state = now, start()
                found.extend(step(state, row))
            yield batch_of(found)
        if finish and key is not None:
            yield batch_of(list(finish(key, state)))

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
