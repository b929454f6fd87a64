"""Most frequent items by lossy counting, with guaranteed count intervals and bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandframe.session import cut

FORM = "slot int, val long, low long, undercount long, buckets long"


class LossyCounter:
    """Lossy counting of 64-bit values; entries are kept as sorted arrays and updated a block at a time.

    With bucket width w, after n values an entry's count is at most its true count and at least it minus n / w; an
    entry that was pruned or never seen has a true count of at most n / w. At most w log(n / w) entries are kept.
    """

    def __init__(self, width: int) -> None:
        self.width, self.seen = width, 0
        self.val = np.zeros(0, np.int64)
        self.low = np.zeros(0, np.int64)
        self.under = np.zeros(0, np.int64)

    @property
    def bucket(self) -> int:
        """Buckets that have been completed: the largest undercount that any value can have."""
        return self.seen // self.width

    def add(self, values: np.ndarray) -> None:
        start = self.bucket
        val, n = np.unique(values, return_counts=True)
        self.seen += len(values)
        at = np.searchsorted(self.val, val)
        known = at < len(self.val)
        known[known] = self.val[at[known]] == val[known]
        self.low[at[known]] += n[known]
        fresh = ~known
        merged = np.concatenate((self.val, val[fresh]))
        order = np.argsort(merged, kind="stable")
        self.val = merged[order]
        self.low = np.concatenate((self.low, n[fresh]))[order]
        self.under = np.concatenate((self.under, np.full(int(fresh.sum()), start)))[order]
        if self.bucket > start:
            keep = self.low + self.under > self.bucket
            self.val, self.low, self.under = self.val[keep], self.low[keep], self.under[keep]


def frequent_items(df: DataFrame, columns: list[str], width: int = 4000, block: int = 1 << 16) -> DataFrame:
    """(slot, val, low, high, total): candidates of each LONG column with an interval that holds the true count.

    ``slot`` numbers the columns; ``total`` is the number of counted values of that column. Every value with a count
    above total / width is returned, and high - low is at most total / width. Nulls aren't counted; an empty table
    gives no rows. The work is one pass with a counter per partition and column, whose size doesn't depend on the
    number of distinct values; only the entries that survive are shuffled, summed, and their undercounts with them.
    """
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [LossyCounter(width) for _ in range(n)]
        held: list[list[np.ndarray]] = [[] for _ in range(n)]
        size = [0] * n

        def flush(i: int) -> None:
            if size[i]:
                counters[i].add(np.concatenate(held[i]))
                held[i], size[i] = [], 0

        for batch in batches:
            for i in range(n):
                got = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                held[i].append(got)
                size[i] += len(got)
                if size[i] >= block:
                    flush(i)
        for i, c in enumerate(counters):
            flush(i)
            if c.seen:  # the first row of a slot tells how much was counted, and how much a value without an entry may lack
                k = len(c.val) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, i, np.int32)), pa.array([None, *c.val.tolist()], pa.int64()), pa.array(np.concatenate(([c.seen], c.low))), pa.array(np.concatenate(([c.bucket], c.under))), pa.array(np.full(k, c.bucket, np.int64))], ["slot", "val", "low", "undercount", "buckets"])

    src = df.select(*(F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(columns)))
    # cut, as the totals and the values are both taken from it: what is written is as small as the summaries
    merged = cut(src.mapInArrow(run, FORM).groupBy("slot", "val").agg(*(F.sum(c).alias(c) for c in ("low", "undercount", "buckets"))))
    total = merged.where("val IS NULL").select("slot", F.col("low").alias("total"), F.col("buckets").alias("all_buckets"))
    out = merged.where("val IS NOT NULL").join(F.broadcast(total), "slot")  # one row a column
    # where a partition has no entry, the value may lack all of that partition's buckets
    return out.select("slot", "val", "low", (F.col("low") + F.col("undercount") + F.col("all_buckets") - F.col("buckets")).alias("high"), "total")


def above_share(found: DataFrame, share: float) -> DataFrame:
    """The candidates that are certain to have at least ``share`` of the total, or can't be told apart from it."""
    return found.where(F.col("high") >= F.ceil(F.col("total") * F.lit(share)))
