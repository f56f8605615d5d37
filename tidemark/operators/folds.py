"""Sequential folds of each group in order, in constant memory: groups of any size stream through one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

State = Any


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[tuple], State], step: Callable[[State, tuple], Iterator[tuple]], finish: Callable[[State], Iterator[tuple]]) -> DataFrame:
    """Rows that step and finish yield for each group of keys, whose rows come by `order`.

    Rows are tuples of df's columns. Partitioned by keys and sorted once; the state of one group is held.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)) if batch.num_rows else ():
                key = tuple(row[i] for i in at)
                if state is None or key != group:
                    if state is not None:
                        out += finish(state)
                    group, state = key, start(key)
                out += step(state, row)
                if len(out) >= 10_000:
                    yield made(out)
                    out = []
        if state is not None:
            out += finish(state)
        if out:
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    df.sparkSession  # the parser of schemas needs a session
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
