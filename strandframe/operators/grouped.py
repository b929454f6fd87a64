"""Streaming over groups: rows are placed by key, sorted, and handed to a function group by group.

Unlike a grouped map, one Arrow stream serves all groups of a partition, so millions of small groups cost no overhead
of their own. A group is held in memory while it is worked on; the callers' groups are bounded by one record or one
pair of records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

FLUSH = 20_000


def grouped_scan(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, list[dict]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """Applies ``fn(key, rows)`` to each group; it gives tuples in the order of ``schema``."""
    form = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = form.names
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(form)
        now, rows, out = None, [], []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    if rows:
                        out.extend(fn(now, rows))
                        if len(out) >= FLUSH:
                            yield batch()
                            out.clear()
                    now, rows = key, []
                rows.append(row)
        if rows:
            out.extend(fn(now, rows))
        yield batch()

    return placed.mapInArrow(run, form)
