"""Long spans that appear verbatim in more than one record.

Every window of ``length`` tokens is compared by its Rabin-Karp hash. So that the windows needn't be shuffled one by one,
runs of neighbouring windows with the same minimizer travel together as a piece of sequence, packed at two bits a base:
equal windows have equal minimizers, so they meet in the same place, in one shuffle. There pieces whose minimizer only one
record has are dropped, pieces that two records have are shared as they are, and the rest is hashed window by window and
counted by distinct record. Overlapping shared windows are merged into maximal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandframe.operators.intervals_merge import merge_intervals
from strandframe.session import cut, stored

#: The two Rabin-Karp hashes, joined to one of 62 bits: c of the prime modulus 2^31 - c, and the base.
HASHES = ((1, 1103515245), (19, 69069))
MERGE_K = 20
MOST_WINDOWS = 256
#: Letters of sequence that are cut into pieces at once, and windows that are hashed at once; both fit a processor's cache.
CHUNK, AT_ONCE = 1 << 16, 1 << 20
#: Windows from which a minimizer is spread over all tasks, and windows of a task.
SPREAD_WINDOWS, TASK_WINDOWS = 1 << 22, 1 << 26
U = np.uint64

_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _c in _pair:
        _CODE[ord(_c)] = _i


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    reach, done = x, 1
    while done * 2 <= w:
        reach = np.minimum(reach[: len(reach) - done], reach[done:])
        done *= 2
    rest = w - done
    return np.minimum(reach[: len(reach) - rest], reach[rest:]) if rest else reach


def _kmers(code: np.ndarray, k: int) -> np.ndarray:
    """The k letters from each place on as one number, put together from runs of 1, 2, 4, ... letters."""
    run, size, out, got = code.astype(U), 1, None, 0
    while True:
        if k & size:
            n = len(code) - k + 1
            part = run[got : got + n] if out is not None else run[:n]
            # runs of rising size are put behind each other
            out = part if out is None else (out << U(2 * size)) | part
            got += size
        if size * 2 > k:
            return out
        run = (run[: len(run) - size] << U(2 * size)) | run[size:]
        size *= 2


def minimizers(code: np.ndarray, length: int, k: int) -> np.ndarray:
    """The minimizer of each window of ``length`` codes: its k-mer of least rank. Repetitive k-mers rank last.

    A k-mer with a period of up to 3 is taken only where a window has nothing else, so long runs of one motif
    don't draw the windows around them to one place.
    """
    kmer = _kmers(code & 3, k)
    dull = np.zeros(len(kmer), bool)
    for p in (1, 2, 3):
        dull |= ((kmer ^ (kmer >> U(2 * p))) << U(64 - 2 * (k - p))) == 0
    # an invertible scrambling (public-domain splitmix finaliser, first half)
    rank = kmer ^ (kmer >> U(30))
    rank *= U(0xBF58476D1CE4E5B9)
    rank ^= rank >> U(27)
    rank >>= U(1)
    rank[dull] |= U(1 << 63)
    return _sliding_min(rank, length - k + 1)


def cut_pieces(texts: list[bytes], length: int, k: int):
    """(text index, first window, windows, minimizer, packed bases) of each run of windows, for texts taken together."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    code = _CODE[joined]
    if len(code) < length:
        return None
    bad = np.concatenate(([0], np.cumsum(code > 3, dtype=np.int64)))
    valid = bad[length:] == bad[:-length]
    least = minimizers(code, length, k)
    turn = np.concatenate(([True], least[1:] != least[:-1]))
    starts = np.flatnonzero(valid & (turn | np.concatenate(([True], ~valid[:-1]))))
    if not len(starts):
        return None
    stops = np.flatnonzero(valid & (np.concatenate((turn[1:], [True])) | np.concatenate((~valid[1:], [True])))) + 1
    # long runs are cut, so that a piece has a bounded size
    times = -(-(stops - starts) // MOST_WINDOWS)
    if (times > 1).any():
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts, stops = np.repeat(starts, times) + part * MOST_WINDOWS, np.repeat(stops, times)
        stops = np.minimum(stops, starts + MOST_WINDOWS)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    owner = np.searchsorted(begins, starts, side="right") - 1
    # four letters from every place on are one byte; a piece takes every fourth of them, and its last byte loses what lies behind it
    c = np.concatenate((code & 3, np.zeros(3, np.uint8)))
    quad = (c[:-3] << 6) | (c[1:-2] << 4) | (c[2:-1] << 2) | c[3:]
    size = stops - starts + length - 1
    wide = (size + 3) // 4
    offset = np.concatenate(([0], np.cumsum(wide)))
    packed = quad[np.repeat(starts - 4 * offset[:-1], wide) + 4 * np.arange(offset[-1])]
    packed[offset[1:] - 1] &= np.array([0xFF, 0xC0, 0xF0, 0xFC], np.uint8)[size % 4]
    blob = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offset.astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
    return owner, starts - begins[owner], stops - starts, least[starts].astype(np.int64), blob


@cache
def _powers(c: int, base: int, n: int) -> np.ndarray:
    p, out = (1 << 31) - c, [1]
    while len(out) < n:
        out.append(out[-1] * base % p)
    return np.array(out, U)


def _modulo(x: np.ndarray, c: int) -> np.ndarray:
    """x modulo 2^31 - c for x below 2^63: 2^31 is worth c."""
    low, shift = U((1 << 31) - 1), U(31)
    for _ in range(3):
        x = (x & low) + (x >> shift) * U(c)
    p = U((1 << 31) - c)
    return np.where(x >= p, x - p, x)


def window_hashes(pieces: pa.Array | list[bytes], windows: np.ndarray, length: int) -> np.ndarray:
    """The Rabin-Karp hashes of all windows of packed pieces, piece after piece.

    Each is a difference of prefix sums of (code + 1) times a power of the base; sums that begin at different places
    are made comparable by lifting all to the same power.
    """
    blob = pieces if isinstance(pieces, pa.Array) else pa.array(pieces, pa.binary())
    n, span = len(blob), MOST_WINDOWS + length - 1
    if not n:
        return np.zeros(0, np.int64)
    begin = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + n + 1].astype(np.int64)
    data = np.concatenate((np.frombuffer(blob.buffers()[2], np.uint8), np.zeros(span // 4 + 1, np.uint8)))
    out = []
    for bgn in range(0, n, 2048):
        w = windows[bgn : bgn + 2048]
        most = int(w.max())
        grid = data[begin[bgn : bgn + len(w), None] + np.arange((most + length + 2) // 4)]
        codes = np.stack((grid >> 6, grid >> 4 & 3, grid >> 2 & 3, grid & 3), axis=2).reshape(len(w), -1)[:, : most + length - 1]
        total = np.zeros((len(w), most), U)
        for c, base in HASHES:
            power = _powers(c, base, span)
            prefix = np.zeros((len(w), most + length), U)
            np.cumsum((codes + np.uint8(1)) * power[: most + length - 1], axis=1, out=prefix[:, 1:])
            window = _modulo(prefix[:, length:] - prefix[:, :most], c)
            total = (total << U(31)) | _modulo(window * power[MOST_WINDOWS - most : MOST_WINDOWS][::-1], c)
        out.append(total[np.arange(most)[None, :] < w[:, None]])
    return np.concatenate(out).astype(np.int64)


def _places(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of pieces taken one after another: the piece, and the place within it."""
    piece = np.repeat(np.arange(len(windows)), windows)
    return piece, np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)


def shared_runs(pieces: pa.Array | list[bytes], windows: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, begin, end) of the stretches covered by windows that two records have; lo and hi are ranks of record ids."""
    hashes = window_hashes(pieces, windows, length)
    piece, at = _places(windows)
    if not len(hashes):
        return piece, at, at
    order = np.argsort(hashes)
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    least, most = np.minimum.reduceat(lo[piece[order]], first), np.maximum.reduceat(hi[piece[order]], first)
    shared = np.zeros(len(hashes), bool)
    shared[order] = np.repeat(least != most, np.diff(np.concatenate((first, [len(ranked)]))))
    piece, at = piece[shared], at[shared]
    fresh = np.concatenate(([True], (piece[1:] != piece[:-1]) | (at[1:] - at[:-1] > length)))[: len(piece)]
    bgn = np.flatnonzero(fresh)
    end = np.concatenate((bgn[1:], [len(piece)]))[: len(bgn)] - 1
    return piece[bgn], at[bgn], at[end] + length


def _ends(group: np.ndarray, n: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest rank of each of n groups."""
    order = np.argsort(group)
    first = np.searchsorted(group[order], np.arange(n))
    return np.minimum.reduceat(ranks[order], first), np.maximum.reduceat(ranks[order], first)


def spans_of_pieces(ids: pa.Array, first: np.ndarray, windows: np.ndarray, m: np.ndarray, blob: pa.Array, length: int):
    """(rows, begin, end): the shared stretches of pieces, with the row of each. All pieces of a minimizer are there, in order of m."""
    rank = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    group = np.concatenate(([0], np.cumsum(m[1:] != m[:-1])))
    lo, hi = _ends(group, int(group[-1]) + 1, rank)
    rows = np.flatnonzero((lo != hi)[group])  # the others have windows that one record has alone
    if not len(rows):
        return rows, rows, rows
    group, rank, windows, first = group[rows], rank[rows], windows[rows], first[rows]
    coded = blob.take(pa.array(rows)).dictionary_encode()
    # pieces are equal if their bytes are and the letters in the last byte are as many
    _, sample, own = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + windows % 4, return_index=True, return_inverse=True)
    lo, hi = _ends(own, len(sample), rank)
    # where all pieces of a minimizer are in two records, there is nothing left to compare
    open_ = np.zeros(int(group[-1]) + 1, bool)
    open_[group[sample[lo == hi]]] = True
    some = np.flatnonzero(open_[group[sample]])
    some = some[np.argsort(windows[sample[some]])]  # pieces of similar size go together
    piece, bgn, end = shared_runs(coded.dictionary.take(coded.indices.take(pa.array(sample[some]))), windows[sample[some]], lo[some], hi[some], length)
    whole = np.flatnonzero(~open_[group[sample]])
    piece = np.concatenate((some[piece], whole))
    bgn = np.concatenate((bgn, np.zeros(len(whole), np.int64)))
    end = np.concatenate((end, windows[sample[whole]] + length - 1))
    # the runs of a piece belong to each of its rows
    order = np.argsort(piece)
    n = np.bincount(piece, minlength=len(sample))
    begin = np.cumsum(n) - n
    times = n[own]
    row = np.repeat(np.arange(len(rows)), times)
    run = order[np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[own], times)]
    return rows[row], first[row] + bgn[run], first[row] + end[run]


def _count_together(length: int):
    """Spans (id, bgn, end_pos) of pieces that come in order of their minimizers; some minimizers are held at a time."""

    def found(held: list[pa.RecordBatch], upto: int | None = None) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).slice(0, upto).combine_chunks().to_batches()[0]
        first, windows, m = (t.column(c).to_numpy() for c in (1, 2, 3))
        rows, bgn, end = spans_of_pieces(t.column(0), first, windows.astype(np.int64), m, t.column(4), length)
        yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(rows)), pa.array(bgn, pa.int64()), pa.array(end, pa.int64())], ["id", "bgn", "end_pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(3).to_numpy()
            if size >= AT_ONCE and m[-1] != held[0].column(3)[0].as_py():
                # the minimizers before the last one of this batch are complete
                last = int(np.searchsorted(m, m[-1]))
                if last or held[-1].column(3)[-1].as_py() != m[-1]:
                    yield from found([*held, batch.slice(0, last)])
                    held, size, batch = [], 0, batch.slice(last)
            held.append(batch)
            size += int(batch.column(2).to_numpy().sum())
        if held:
            yield from found(held)

    return run


def _explode_windows(length: int):
    """The windows of pieces as rows (m, code, lo, hi, at, hash), for minimizers with too many pieces for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                windows = b.column(3).to_numpy().astype(np.int64)
                hashes = window_hashes(b.column(2), windows, length)
                piece, at = _places(windows)
                own = pa.array(piece)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), b.column(4).take(own), b.column(5).take(own), pa.array(at.astype(np.int32)), pa.array(hashes)], ["m", "code", "lo", "hi", "at", "hash"])

    return run


def _pieces(records: DataFrame, length: int, k: int) -> DataFrame:
    """(id, first, windows, m, piece) of all records; long records are worked off in chunks."""
    kind = records.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            texts, rows, shifts, held, done = [], [], [], 0, []
            for i, s in enumerate(batch.column(1)):
                raw = s.as_py().encode("ascii", "replace")
                for at in range(0, max(len(raw) - length + 1, 0), CHUNK):
                    part = raw[at : at + CHUNK + length - 1]
                    texts.append(part), rows.append(i), shifts.append(at)
                    held += len(part)
                    if held >= CHUNK:
                        done += made(ids, texts, rows, shifts)
                        texts, rows, shifts, held = [], [], [], 0
                        if len(done) >= 16:
                            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                            done = []
            if texts:
                done += made(ids, texts, rows, shifts)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    def made(ids, texts, rows, shifts) -> list[pa.RecordBatch]:
        got = cut_pieces(texts, length, k)
        if got is None:
            return []
        owner, first, windows, m, blob = got
        return [pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(rows)[owner])), pa.array(first + np.array(shifts, np.int64)[owner]), pa.array(windows.astype(np.int32)), pa.array(m), blob], ["id", "first", "windows", "m", "piece"])]

    form = T.StructType([T.StructField("id", kind), T.StructField("first", T.LongType()), T.StructField("windows", T.IntegerType()), T.StructField("m", T.LongType()), T.StructField("piece", T.BinaryType())])
    return records.mapInArrow(run, form)


def _weights(records: DataFrame, length: int, k: int, spread: int) -> tuple[list[int], float]:
    """The minimizers with more than ``spread`` windows, and the number of all windows, estimated from a sample of records.

    The sample of 16 times the square root of the records only decides where windows are counted, and nothing about the result. A minimizer
    is taken for frequent if at least eight of its pieces are in the sample.
    """
    n = records.count()
    share = min(1.0, 16 / sqrt(n)) if n else 1.0
    sampled = _pieces(records.sample(share, seed=0), length, k)
    by = sampled.groupBy("m").agg(F.count("*").alias("pieces"), F.sum("windows").alias("windows"))
    by = cut(by)
    windows = (by.agg(F.sum("windows")).first()[0] or 0) / share
    # at most an eighth of the sample's pieces
    return [r.m for r in by.where((F.col("pieces") >= 8) & (F.col("windows") > spread * share)).select("m").collect()], windows


def shared_spans(df: DataFrame, key: str, seq: str, length: int = 100, k: int = MERGE_K, spread: int = SPREAD_WINDOWS) -> DataFrame:
    """(key, bgn, end_pos): the maximal stretches of each record covered by windows that another record has too.

    Letter case is ignored; windows with letters other than A, C, G and T aren't compared; strands are told apart.
    Rows repeated with the same key are one record; null keys and texts, and texts shorter than ``length``, give no
    rows; further columns aren't read. Minimizers with more than ``spread`` windows are spread by the windows' own hashes
    instead of staying together; it changes the plan and not the result.
    """
    records = df.select(F.col(key).alias("id"), F.col(seq).alias("seq")).where("id IS NOT NULL AND seq IS NOT NULL")
    kind = records.schema["id"].dataType.simpleString()
    hot, windows = _weights(records, length, k, spread)
    placed = _pieces(records, length, k)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(windows // TASK_WINDOWS))
    together = placed
    if hot:
        frequent = df.sparkSession.createDataFrame([(m,) for m in hot], "m long")
        placed = cut(placed)  # read on both ways
        together = placed.join(frequent, "m", "left_anti").select("id", "first", "windows", "m", "piece")
    spans = together.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(_count_together(length), f"id {kind}, bgn long, end_pos long")
    if hot:
        spans = spans.unionByName(_spread(placed.join(frequent, "m", "left_semi"), length, kind))
    spans = stored(spans)  # the range sort of the merge reads them twice
    return merge_intervals(spans, "id", "bgn", "end_pos", gaps=False).select(F.col("entity").alias(key), "bgn", "end_pos")


def _spread(placed: DataFrame, length: int, kind: str) -> DataFrame:
    """The spans of pieces of frequent minimizers: equal pieces are combined, and their windows counted as rows of their own."""
    placed = placed.withColumn("code", F.xxhash64("piece", "windows"))
    distinct = placed.groupBy("m", "piece", "windows", "code").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    apart = distinct.select("m", "code", "piece", "windows", "lo", "hi").mapInArrow(_explode_windows(length), f"m long, code long, lo {kind}, hi {kind}, at int, hash long")
    counted = apart.groupBy("m", "hash").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("m", "hash")
    runs = _runs(apart.join(counted, ["m", "hash"]), length)
    spans = placed.select("id", "first", "m", "code").join(runs, ["m", "code"])
    return spans.select("id", (F.col("first") + F.col("r_bgn")).alias("bgn"), (F.col("first") + F.col("r_end")).alias("end_pos"))


def _runs(hits: DataFrame, length: int) -> DataFrame:
    """(m, code, r_bgn, r_end): the stretches of each piece that its shared windows cover; a piece has at most MOST_WINDOWS."""
    at = F.sort_array(F.collect_list("at"))
    found = hits.groupBy("m", "code").agg(at.alias("at"))
    bgn = F.filter("at", lambda x, i: (i == 0) | (x - F.get("at", i - 1) > length))
    end = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) - x > length))
    runs = found.select("m", "code", F.explode(F.arrays_zip(bgn.alias("b"), end.alias("e"))).alias("r"))
    return runs.select("m", "code", F.col("r.b").alias("r_bgn"), (F.col("r.e") + length).alias("r_end"))


def shared_sizes(spans: DataFrame, key: str) -> DataFrame:
    """(key, n_spans, shared_bases): how much of each record is shared elsewhere."""
    return spans.groupBy(key).agg(F.count("*").alias("n_spans"), F.sum(F.col("end_pos") - F.col("bgn")).alias("shared_bases"))
