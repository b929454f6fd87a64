"""Sparse minimizers of sequences, and the pairs of neighbouring ones.

One Arrow UDF takes whole sequences and gives the selected marks, so k-mers never become rows. K-mers of a batch are
coded with a logarithmic number of vector operations. The windowed selection jumps from one selected mark to the
next instead of visiting each k-mer. A sequence's pairs are made in the same pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

U = np.uint64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fixed value: the constant that tells the high plane's hash from the low plane's.
PLANE_SALT = 0xAD12CF59

_BASE = np.full(256, 4, np.uint8)
for _i, _letters in enumerate(("Aa\x00", "Cc\x01", "Gg\x02", "Tt\x03")):
    for _c in _letters:
        _BASE[ord(_c)] = _i


@dataclass(frozen=True)
class ShimmerSpec:
    """Window, k-mer size, reduction, least distance of neighbours, and whether marks are sketched instead of windowed."""

    w: int = 80
    k: int = 56
    r: int = 4
    min_span: int = 64
    sketch: bool = True

    def __post_init__(self) -> None:
        if not (0 < self.k <= 56 and 0 < self.w <= 128 and 0 <= self.r < 13 and (self.sketch or self.r > 0)):
            raise ValueError(f"not a valid specification: {self}")


def scramble(key: np.ndarray) -> np.ndarray:
    """Thomas Wang's invertible 64-bit integer mix, step by step as published; additions and shifts wrap. Its shifts are fixed values."""
    key = ~key + (key << U(21))
    key = key ^ (key >> U(24))
    key = key + (key << U(3)) + (key << U(8))
    key = key ^ (key >> U(14))
    key = key + (key << U(2)) + (key << U(4))
    key = key ^ (key >> U(28))
    return key + (key << U(31))


def _gather(bits: np.ndarray, k: int, newest_first: bool) -> np.ndarray:
    """At each place the last k bits as one word, the newest at bit 0 or at bit k - 1. Missing bits are 0."""

    def shifted(a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(a)
        if by < len(a):
            out[by:] = a[: len(a) - by]
        return out

    word, size, out, got = bits.astype(np.uint64), 1, np.zeros(len(bits), np.uint64), 0
    while True:
        if k & size:
            # 'word' holds the last 'size' bits; 'out' holds the 'got' newest ones
            older = shifted(word, got)
            out = out | (older << U(got)) if newest_first else (out << U(size)) | older
            got += size
        if size * 2 > k:
            return out
        older = shifted(word, size)
        word = word | (older << U(size)) if newest_first else (word << U(size)) | older
        size *= 2


def candidates(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position of the last base, 64-bit value, strand) of each k-mer, and the value with the span packed.

    Letters that aren't bases leave the k-mer as it was, so it is given again; the k-mer that ends at k - 1 is never
    given; k-mers equal to their reverse complement are left out.
    """
    code = _BASE[np.frombuffer(seq, np.uint8)]
    base = code < 4
    c = code[base]
    low, high = c & 1, c >> 1
    planes = [_gather(low, k, True), _gather(high, k, True), _gather(low ^ 1, k, False), _gather(high ^ 1, k, False)]
    seen = np.cumsum(base)
    pos = np.arange(k, len(code))
    at = seen[k:] - 1
    some = at >= 0
    pos, at = pos[some], at[some]
    fl, fh, rl, rh = (p[at] for p in planes)
    keep = (fl != rl) | (fh != rh)
    fl, fh, rl, rh, pos = fl[keep], fh[keep], rl[keep], rh[keep], pos[keep]
    back = rl < fl
    value = scramble(np.where(back, rl, fl)) ^ scramble(np.where(back, rh, fh) ^ U(PLANE_SALT))
    return pos, value, back.astype(np.int32), (value << U(8)) | U(k)


def select(x: np.ndarray, place: np.ndarray, window: int, first: int, last: int) -> list[int]:
    """Indices of the windowed minima of x, in order of their selection.

    A counter tells how far the current minimum lies back, in units of ``place`` when it is set and by one for each
    element after. When it reaches the window, all elements of the last ``window`` that equal their minimum are taken;
    before, an element not above the current minimum is taken if its place lies in [first, last).
    """
    out: list[int] = []
    n, i, d, low = len(x), 0, 0, FULL
    allowed = (place >= first) & (place < last)
    while i < n:
        full = i + window - 1 - d if d < window else n
        stop = min(full, n)
        early = -1
        at = i
        while at < stop and early < 0:
            to = min(stop, at + 4 * window)
            hit = np.flatnonzero((x[at:to] <= low) & allowed[at:to])
            early, at = (at + int(hit[0]), at) if len(hit) else (-1, to)
        if early >= 0:
            out.append(early)
            low, d, i = x[early], 0, early + 1
        elif full < n:
            lo = max(0, full - window + 1)
            ring = x[lo : full + 1]
            same = np.flatnonzero(ring == ring.min()) + lo
            out.extend(same.tolist())
            low, d, i = x[same[-1]], int(place[full] - place[same[-1]]), full + 1
        else:
            break
    return out


def _reduce(x: np.ndarray, r: int, padding: bool) -> np.ndarray:
    """Indices kept by one reduction: minima over r neighbours of a list, optionally padded so that both ends stay."""
    pad = r - 1 if padding else 0
    padded = np.concatenate((np.full(pad, FULL), x, np.full(pad, FULL)))
    kept = np.array(select(padded, np.arange(len(padded)), r, r, len(padded)), np.int64) - pad
    return kept[(kept >= 0) & (kept < len(x))]


def sequence_marks(seq: bytes, spec: ShimmerSpec, padding: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, strand) of the marks of one sequence. Null and short sequences have none."""
    none = np.zeros(0, np.int64)
    if len(seq) <= spec.k:
        return none, none, none
    pos, value, strand, x = candidates(seq, spec.k)
    if spec.sketch:
        kept = np.flatnonzero(value < (FULL >> U(4)) >> U(spec.r))
    else:
        kept = np.array(select(x, pos, spec.w, spec.w + spec.k, len(seq) - spec.w + spec.k), np.int64)
        for _ in range(2 if spec.r > 1 else 0):
            kept = kept[_reduce(x[kept], spec.r, padding)] if len(kept) else kept
    p, v = pos[kept], x[kept]
    if len(kept) > 2:
        gap, differs = np.diff(p), v[1:] != v[:-1]
        inner = (gap[:-1] > spec.min_span) & (gap[1:] > spec.min_span) & differs[:-1] & differs[1:]
        stay = np.concatenate(([True], inner, [True]))
        kept, p, v = kept[stay], p[stay], v[stay]
    return (v >> U(8)).astype(np.int64), p.astype(np.int64), strand[kept]


def _each(batches: Iterator[pa.RecordBatch], spec: ShimmerSpec, padding: bool):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for sid, seq in zip(ids, batch.column(1).to_pylist()):
            yield batch.schema.field(0).type, sid, *sequence_marks((seq or "").encode("ascii", "replace"), spec, padding)


def shimmers(sequences: DataFrame, spec: ShimmerSpec, padding: bool = False, key: str = "sid") -> DataFrame:
    """(sid, ord, hash, span, pos, strand): the marks of each sequence, in order. Null sequences have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, sid, h, p, s in _each(batches, spec, padding):
            n = len(h)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([sid] * n, kind), pa.array(np.arange(n, dtype=np.int32)), pa.array(h), pa.array(np.full(n, spec.k, np.int32)), pa.array(p.astype(np.int32)), pa.array(s.astype(np.int32))], ["sid", "ord", "hash", "span", "pos", "strand"])

    kind = sequences.schema[key].dataType.simpleString()
    return sequences.select(key, "seq").mapInArrow(run, f"sid {kind}, ord int, hash long, span int, pos int, strand int")


def shimmer_pairs(sequences: DataFrame, spec: ShimmerSpec, padding: bool = False, query: bool = False, key: str = "sid") -> DataFrame:
    """(sid, ord, h0, h1, bgn, end_pos, orientation): neighbouring marks as canonical pairs, made without a shuffle.

    The smaller hash comes first, orientation 1 tells that it was the second. Equal hashes have orientation 0 in an
    index and 1 in a query (``query``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, sid, h, p, _ in _each(batches, spec, padding):
            if len(h) > 1:
                a, b, n = h[:-1], h[1:], len(h) - 1
                turned = (a >= b) if query else (a > b)
                yield pa.RecordBatch.from_arrays([pa.array([sid] * n, kind), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array((p[:-1] + 1).astype(np.int32)), pa.array((p[1:] + 1).astype(np.int32)), pa.array(turned.astype(np.int32))], ["sid", "ord", "h0", "h1", "bgn", "end_pos", "orientation"])

    kind = sequences.schema[key].dataType.simpleString()
    return sequences.select(key, "seq").mapInArrow(run, f"sid {kind}, ord int, h0 long, h1 long, bgn int, end_pos int, orientation int")


def pair_marks(marks: DataFrame, query: bool = False) -> DataFrame:
    """Pairs from a stored table of marks (sid, ord, hash, pos): neighbours by ord, in one window per sequence."""
    from pyspark.sql import Window

    w = Window.partitionBy("sid").orderBy("ord")
    both = marks.select("sid", "ord", "hash", "pos", F.lead("hash").over(w).alias("next_hash"), F.lead("pos").over(w).alias("next_pos")).where("next_hash IS NOT NULL")
    turned = (F.col("hash") >= F.col("next_hash")) if query else (F.col("hash") > F.col("next_hash"))
    return both.select("sid", "ord", F.least("hash", "next_hash").alias("h0"), F.greatest("hash", "next_hash").alias("h1"), (F.col("pos") + 1).alias("bgn"), (F.col("next_pos") + 1).alias("end_pos"), turned.cast("int").alias("orientation"))
