"""Splitting of items above a size limit at natural boundaries, with an overlap between neighbouring pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PIECES = "id long, bgn long, end_pos long"
#: Successive part ids of which an item asks for at once.
BLOCK = 32


class FurthestCut:
    """Pieces that each end at the furthest boundary within the limit; boundaries come in ascending order.

    Nothing is kept of a record but the place of the piece in work and one boundary.
    """

    def __init__(self, size: int, limit: int, overlap: int) -> None:
        self.size, self.limit, self.overlap = size, limit, overlap
        self.bgn = self.last = 0
        self.best: int | None = None
        self.out: list[tuple[int, int]] = []

    def _cut(self) -> None:
        end = self.bgn + self.limit if self.best is None else self.best
        self.out.append((self.bgn, end))
        self.last, self.bgn, self.best = end, end - self.overlap, None

    def boundary(self, at: int, strength: int) -> None:
        if at <= self.size:
            while at > self.bgn + self.limit:
                self._cut()
            if at > self.last:
                self.best = at

    def close(self) -> list[tuple[int, int]]:
        while self.bgn + self.limit < self.size:
            self._cut()
        return [*self.out, (self.bgn, self.size)]


class Bisection:
    """Recursive bisection: the strongest boundary of the middle half, nearest to the midpoint among equals, cuts.

    Halves above the limit minus the overlap are cut again; without a boundary the midpoint is taken. Then each
    piece but the first begins ``overlap`` earlier.
    """

    def __init__(self, size: int, limit: int, overlap: int) -> None:
        self.size, self.most, self.overlap = size, limit - overlap, overlap
        self.at: list[int] = []
        self.strength: list[int] = []

    def boundary(self, at: int, strength: int) -> None:
        if 0 < at < self.size:
            self.at.append(at), self.strength.append(strength)

    def close(self) -> list[tuple[int, int]]:
        from bisect import bisect_left, bisect_right

        ends, work = [], [(0, self.size)]
        while work:
            a, b = work.pop()
            if b - a <= self.most:
                ends.append(b)
                continue
            mid, quarter = (a + b) // 2, (b - a) // 4
            some = range(bisect_left(self.at, max(a + 1, mid - quarter)), bisect_right(self.at, min(b - 1, mid + quarter)))
            best = max(some, key=lambda i: (self.strength[i], -abs(self.at[i] - mid), -self.at[i]), default=None)
            c = mid if best is None else self.at[best]
            work += [(c, b), (a, c)]
        begins = [0, *(max(0, e - self.overlap) for e in ends[:-1])]
        return list(zip(begins, ends))


STRATEGIES: dict[str, Callable] = {"furthest": FurthestCut, "bisect": Bisection}


def split_oversized(items: DataFrame, parts: DataFrame, limit: int, overlap: int, strategy: str = "furthest") -> DataFrame:
    """(id, bgn, end_pos): overlapping pieces of each item above ``limit``, in order.

    ``items`` has LONG id and size, and part_start, part_n: the item consists of parts part_start, part_start + 1, ...
    ``parts`` has LONG part_id and length. The ends of parts are the boundaries. A part that is missing or has a null
    length leaves the boundaries behind it unknown, so none of them are used; parts of no length are no boundaries;
    without a range of parts the pieces are cut by size alone. Items with a null id or size are ignored, rows repeated
    with the same values count once, further columns aren't read. 0 <= overlap < limit is required.

    With the strategy 'furthest' each piece begins exactly ``overlap`` before the end of the one before it, so the second
    piece begins below 0 where the first ends within the overlap; 'bisect' never begins below 0.

    Items and parts meet by blocks of part ids, are placed by item, and scanned in order, so no item's parts are gathered in a row.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    make = STRATEGIES[strategy]
    big = items.where(F.col("id").isNotNull() & (F.col("size") > limit)).select("id", F.col("size").cast("long"), F.col("part_start").cast("long"), F.col("part_n").cast("long")).distinct()
    block = lambda c: F.floor(c / F.lit(BLOCK))
    last = F.col("part_start") + F.col("part_n") - 1
    rows = big.withColumn("block", F.explode_outer(F.when(F.col("part_n") > 0, F.sequence(block(F.col("part_start")), block(last)))))
    known = parts.select("part_id", "length").where("part_id IS NOT NULL").groupBy("part_id").agg(F.max("length").cast("long").alias("length"))
    met = rows.join(known.withColumn("block", block(F.col("part_id"))), "block", "left")
    inside = (F.col("part_id") >= F.col("part_start")) & (F.col("part_id") <= last)
    part_id = F.when(inside, F.col("part_id") - F.col("part_start"))
    # a block without parts in the range keeps a row without a part, so that every item is there
    placed = met.select("id", "size", part_id.alias("nth"), "length").where("nth IS NOT NULL").unionByName(big.select("id", "size", F.lit(-1).cast("long").alias("nth"), F.lit(None).cast("long").alias("length")))
    placed = placed.repartition("id").sortWithinPartitions("id", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, at, sure = None, None, 0, 0  # sure: the number of the next part, -1 behind an unknown one
        ids, begins, ends = [], [], []

        def close() -> None:
            if cutter is not None:
                for b, e in cutter.close():
                    ids.append(now), begins.append(b), ends.append(e)

        for batch in batches:
            for i, size, nth, length in zip(*(c.to_pylist() for c in batch.columns)):
                if i != now:
                    close()
                    now, cutter, at, sure = i, make(size, limit, overlap), 0, 0
                if nth < 0:
                    continue
                if length is None or nth != sure:
                    sure = -1
                    continue
                sure += 1
                if length > 0:
                    at += length
                    cutter.boundary(at, length)
            if len(ids) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["id", "bgn", "end_pos"])
                ids, begins, ends = [], [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["id", "bgn", "end_pos"])

    return placed.mapInArrow(run, PIECES)
