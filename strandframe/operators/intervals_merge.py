"""Merging of overlapping intervals and listing of the gaps, without a group per entity.

The rows are range-sorted by entity and start over all partitions, so that an entity of any size is spread over
as many tasks as its share of the rows asks for. Each partition folds its rows to islands and leaves one summary
row (its last island). The driver combines those summaries, one per partition, from left to right into the state
that reaches each partition, and a second scan of the islands completes them with that carried state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from strandframe.session import cut

_MAX = np.int64(1) << np.int64(62)


def fold_sorted(group: np.ndarray, bgn: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Islands of intervals sorted by (group, bgn); group is non-decreasing. Returns first row, start and end of each."""
    n = len(bgn)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    step = np.concatenate(([0], np.cumsum(group[1:] != group[:-1]))).astype(np.int64)
    low, width = int(end.min()), int(end.max()) - int(end.min()) + 1
    if (int(step[-1]) + 1) * width < _MAX:
        reach = np.maximum.accumulate(end - low + step * width) - step * width + low
    else:
        reach = end.copy()
        for i in range(1, n):
            if step[i] == step[i - 1] and reach[i - 1] > reach[i]:
                reach[i] = reach[i - 1]
    first = np.flatnonzero(np.concatenate(([True], (step[1:] != step[:-1]) | (bgn[1:] > reach[:-1]))))
    last = np.concatenate((first[1:], [n])) - 1
    return first, bgn[first], reach[last]


def _arrays(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _codes(entity: pa.Array) -> np.ndarray:
    return entity.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _batch(entity: pa.Array, bgn: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([entity, pa.array(bgn, pa.int64()), pa.array(end, pa.int64())], ["entity", "bgn", "end_pos"])


def _prefold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Islands within each batch, before anything is shuffled: repeated and nested rows don't travel."""
    for batch in batches:
        if not batch.num_rows:
            continue
        entity, bgn, end = _arrays(batch)
        code = _codes(entity)
        order = np.lexsort((bgn, code))
        first, b, e = fold_sorted(code[order], bgn[order], end[order])
        yield _batch(entity.take(pa.array(order[first])), b, e)


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Disjoint islands of a sorted partition; the last one of a batch waits for the next batch."""
    wait: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if wait is not None:
            batch = pa.Table.from_batches([wait, batch]).combine_chunks().to_batches()[0]
        entity, bgn, end = _arrays(batch)
        first, b, e = fold_sorted(_codes(entity), bgn, end)
        out = _batch(entity.take(pa.array(first)), b, e)
        wait = out.slice(len(b) - 1)
        if len(b) > 1:
            yield out.slice(0, len(b) - 1)
    if wait is not None:
        yield wait


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        if batch.num_rows:
            last = batch.slice(batch.num_rows - 1)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *last.columns], ["part", "entity", "bgn", "end_pos"])


def combine_summaries(rows: list[tuple]) -> tuple[dict[int, tuple], int]:
    """The open island that reaches each partition, and the last partition with rows. rows: (part, entity, bgn, end)."""
    carried, now = {}, None
    for part, entity, bgn, end in sorted(rows, key=lambda r: r[0]):
        carried[part] = now
        now = (entity, now[1], max(now[2], end)) if now and now[0] == entity and bgn <= now[2] else (entity, bgn, end)
    return carried, max((r[0] for r in rows), default=-1)


def _rescan(carried: dict[int, tuple], final: int, gaps: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_ = carried.get(part)
        kind_of = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kind_of = batch.schema.field(0).type
            entity, bgn, end = _arrays(batch)
            i = 0
            while open_ is not None and i < n and bgn[i] <= open_[2] and entity[i].as_py() == open_[0]:
                open_ = (open_[0], open_[1], max(open_[2], int(end[i])))
                i += 1
            if i == n:
                continue
            entity, bgn, end = entity.slice(i), bgn[i:], end[i:]
            if open_ is not None:
                entity = pa.concat_arrays([pa.array([open_[0]], kind_of), entity])
                bgn, end = np.concatenate(([open_[1]], bgn)), np.concatenate(([open_[2]], end))
            open_ = (entity[-1].as_py(), int(bgn[-1]), int(end[-1]))
            yield from _emit(entity.slice(0, len(bgn) - 1), "merged", bgn[:-1], end[:-1])
            if gaps:
                code = _codes(entity)
                hole = np.flatnonzero(code[1:] == code[:-1])
                yield from _emit(entity.take(pa.array(hole)), "gap", end[:-1][hole], bgn[1:][hole])
        if open_ is not None and part == final:
            yield from _emit(pa.array([open_[0]], kind_of), "merged", np.array([open_[1]]), np.array([open_[2]]))

    def _emit(entity: pa.Array, kind: str, bgn: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bgn):
            yield pa.RecordBatch.from_arrays([entity, pa.array([kind] * len(bgn)), pa.array(bgn, pa.int64()), pa.array(end, pa.int64())], ["entity", "kind", "bgn", "end_pos"])

    return run


def merge_intervals(df: DataFrame, entity: str, bgn: str, end: str, gaps: bool = True) -> DataFrame:
    """Continuous covered stretches per entity and, with ``gaps``, the holes between neighbouring stretches.

    Returns (entity, kind, bgn, end_pos) with kind 'merged' or 'gap'. Half-open intervals that overlap or touch
    join; an interval alone is a stretch of its own. Rows with a null entity or bound and rows with bgn >= end are
    ignored; repeated rows, nested rows and ties make no difference; an empty table gives no rows; further
    columns of the input are not read.
    """
    kind = df.schema[entity].dataType
    src = df.select(F.col(f"`{entity}`").alias("entity"), F.col(f"`{bgn}`").cast("long").alias("bgn"), F.col(f"`{end}`").cast("long").alias("end_pos"))
    src = src.where("entity IS NOT NULL AND bgn < end_pos")
    form = T.StructType([T.StructField("entity", kind), T.StructField("bgn", T.LongType()), T.StructField("end_pos", T.LongType())])
    placed = src.mapInArrow(_prefold, form).repartitionByRange("entity", "bgn", "end_pos").sortWithinPartitions("entity", "bgn", "end_pos")
    islands = cut(placed.mapInArrow(_fold_partition, form))
    ends = islands.mapInArrow(_summary, T.StructType([T.StructField("part", T.IntegerType()), *form.fields]))
    carried, final = combine_summaries([tuple(r) for r in ends.collect()])  # one row a partition
    out = T.StructType([form.fields[0], T.StructField("kind", T.StringType()), *form.fields[1:]])
    return islands.mapInArrow(_rescan(carried, final, gaps), out)
