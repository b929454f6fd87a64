"""Base-level alignment kernels and the tables made from them. The kernels run in one Arrow stream over pairs of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

_OPS = StructType([StructField("op", StringType()), StructField("bgn", IntegerType()), StructField("end", IntegerType()), StructField("letter", StringType())])


def _slide(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many letters are equal from i[k] in x and j[k] in y on, for all k together; both end in BLOCK letters that differ."""
    total, on = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(on):
        at = total[on, None] + np.arange(BLOCK)
        differ = x[i[on, None] + at] != y[j[on, None] + at]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), BLOCK)
        total[on] += n
        on = on[n == BLOCK]
    return total


#: Letters that are compared at once.
BLOCK = 16


def greedy_overlap(a: bytes, b: bytes, tolerance: float = 0.1, band: int = 32, min_start: int = 0) -> dict | None:
    """Greedy O(nD) overlap (Myers 1986) of two sequences from their begins until either is used up; None if they differ too much.

    The furthest places of all diagonals after d inserted and deleted letters are one array, and each step moves all of them.
    Diagonals that lag behind the furthest by more than ``band`` letters of both sequences are dropped; the search ends when the
    others are further apart than that, or 32 + tolerance x the shorter length letters are spent. Result, all taken from the path
    that ends first (the furthest of several, then the least diagonal): its inserted and deleted letters behind the first run of at least
    ``min_start`` matches, where that run begins, where the path and where its longest run ends, its size, and the runs (x, y, length).
    """
    n, m = len(a), len(b)
    x, y = (np.concatenate((np.frombuffer(s, np.uint8).astype(np.int16), np.full(BLOCK + 1, end, np.int16))) for s, end in ((a, -1), (b, -2)))
    gone = np.int64(-4) * (n + m + 4)
    low, far = 0, _slide(x, y, np.zeros(1, np.int64), np.zeros(1, np.int64))  # diagonals low, low + 2, ...
    history = [(low, far)]
    for d in range(32 + int(tolerance * min(n, m))):
        diagonal = low + 2 * np.arange(len(far))
        over = np.flatnonzero((far >= 0) & ((far >= n) | (far - diagonal >= m)))
        if len(over):
            k = diagonal[over[np.argmax((2 * far - diagonal)[over])]]
            return _overlap(history, int(k), min_start)
        reached = 2 * far - diagonal
        far = np.where(reached >= reached.max() - band, far, gone)
        some = np.flatnonzero(far >= 0)
        low, far = low + 2 * int(some[0]), far[some[0] : some[-1] + 1]
        history[-1] = (low, far)
        if 2 * len(far) > band:
            return None
        # a letter of a leads to the diagonal above, a letter of b to the one below
        far = np.maximum(np.concatenate(([gone], far + 1)), np.concatenate((far, [gone])))
        low -= 1
        held = np.flatnonzero(far >= 0)
        far[held] += _slide(x, y, far[held], far[held] - (low + 2 * held))
        history.append((low, far))
    return None


def _overlap(history: list[tuple[int, np.ndarray]], k: int, min_start: int) -> dict:
    """The overlap on the path that ends on diagonal k: its runs of matches are found from the end back."""
    runs = []
    place = lambda d, k: int(history[d][1][(k - history[d][0]) // 2]) if 0 <= k - history[d][0] < 2 * len(history[d][1]) else -1
    for d in range(len(history) - 1, -1, -1):
        end = place(d, k)
        up, same = (place(d - 1, k - 1), place(d - 1, k + 1)) if d else (-1, 0)
        bgn = max(up + 1 if up >= 0 else -1, same) if d else 0
        runs.append((bgn, bgn - k, end - bgn))
        k += -1 if d and up >= 0 and up + 1 == bgn else 1
    runs.reverse()
    first = next((r for r, run in enumerate(runs) if run[2] >= min_start), 0)
    best = max(runs, key=lambda r: r[2])
    (bgn0, bgn1, _), end0, end1 = runs[first], runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]
    spent = len(runs) - 1 - first
    size = (end0 - bgn0 + end1 - bgn1 + 2 * spent) // 2
    return {"distance": spent, "bgn0": bgn0, "end0": end0, "bgn1": bgn1, "end1": end1, "run_end0": best[0] + best[2], "run_end1": best[1] + best[2], "size": size, "runs": runs}


def affine_align(target: str, query: str, mismatch: int = 3, opening: int = 3, extending: int = 1, most: int | None = None) -> tuple[str, str, int] | None:
    """Global gap-affine alignment of least cost: both strings with dashes, and the cost; None if it is above ``most``.

    Rows are computed at once; gaps along a row come from a running minimum. A gap of length g costs opening + g x extending.
    """
    t, q = np.frombuffer(target.encode(), np.uint8), np.frombuffer(query.encode(), np.uint8)
    n, m = len(t), len(q)
    far = np.int64(1) << 40
    slope = np.arange(m + 1, dtype=np.int64) * extending
    best = np.where(slope > 0, opening + slope, 0)
    down = np.full(m + 1, far)
    how = np.zeros((n + 1, m + 1), np.uint8)  # 0 match, 1 gap in the query, 2 gap in the target; 4 and 8: that gap goes on
    how[0, 1:] = 2
    for i in range(1, n + 1):
        fresh, longer = best + opening + extending, down + extending
        down = np.minimum(fresh, longer)
        diagonal = np.concatenate(([far], best[:-1] + np.where(q == t[i - 1], 0, mismatch)))
        upper = np.minimum(diagonal, down)
        across = np.minimum.accumulate(upper - slope) + slope
        side = np.concatenate(([far], across[:-1] + opening + extending))
        best = np.minimum(upper, side)
        how[i] = np.where(best == diagonal, 0, np.where(best == down, 1, 2)) | np.where(longer < fresh, 4, 0)
        how[i, 1:] |= np.where(side[:-1] < upper[:-1] + opening, 8, 0).astype(np.uint8)
    cost = int(best[m])
    if most is not None and cost > most:
        return None
    a, b, i, j, held = [], [], n, m, 0
    while i or j:
        here = int(how[i, j])
        move = 2 if i == 0 else 1 if j == 0 else held or here & 3
        if move == 1:
            held = 1 if here & 4 else 0
            i -= 1
            a.append(target[i]), b.append("-")
        elif move == 2:
            held = 2 if here & 8 else 0
            j -= 1
            a.append("-"), b.append(query[j])
        else:
            i, j = i - 1, j - 1
            a.append(target[i]), b.append(query[j])
    return "".join(reversed(a)), "".join(reversed(b)), cost


#: Cells of the tables of moves that are held at once.
CELLS = 1 << 22


def _tables(pairs: list[tuple[bytes, bytes]], mismatch: int, opening: int, extending: int) -> tuple[np.ndarray, np.ndarray]:
    """(moves, costs) of ``affine_align`` for pairs of similar size: the same rows, each over all pairs, one column a pair."""
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    t, q = (np.array([np.frombuffer(p[k].ljust(top, pad), np.uint8) for p in pairs]).T for k, top, pad in ((0, n.max(), b"\xfe"), (1, m.max(), b"\xff")))
    kind = np.int32 if (int(n.max()) + int(m.max())) * (mismatch + opening + extending) < 1 << 26 else np.int64
    far = kind(1) << kind(28 if kind is np.int32 else 40)
    slope = (np.arange(len(q) + 1, dtype=kind) * kind(extending))[:, None]
    best = np.repeat(np.where(slope > 0, opening + slope, 0), len(pairs), axis=1).astype(kind)
    down, edge = np.full_like(best, far), np.full((1, len(pairs)), far, kind)
    how = np.zeros((len(t) + 1, len(q) + 1, len(pairs)), np.uint8)
    how[0, 1:] = 2
    cost = np.where(n == 0, best[m, np.arange(len(pairs))], 0)
    for i in range(1, len(t) + 1):
        fresh, longer = best + kind(opening + extending), down + kind(extending)
        down = np.minimum(fresh, longer)
        diagonal = np.concatenate((edge, best[:-1] + (q != t[i - 1]) * kind(mismatch)))
        upper = np.minimum(diagonal, down)
        across = np.minimum.accumulate(upper - slope, axis=0) + slope
        side = np.concatenate((edge, across[:-1] + kind(opening + extending)))
        best = np.minimum(upper, side)
        row = (best != diagonal).astype(np.uint8)
        row += row & (best != down)
        row |= (longer < fresh).astype(np.uint8) << 2
        row[1:] |= (side[:-1] < upper[:-1] + kind(opening)).astype(np.uint8) << 3
        how[i] = row
        ends = np.flatnonzero(n == i)
        cost[ends] = best[m[ends], ends]
    return how, cost


def affine_many(pairs: list[tuple[str, str]], mismatch: int = 3, opening: int = 3, extending: int = 1, most: int | None = None, left: bool = False) -> list[tuple[str, str, int] | None]:
    """``affine_align`` of many (target, query) at once, with ``left`` ``align_left``.

    The letters that both have at the end in common, where the path is begun, are matches of any such alignment and left out; what is
    left goes together with pairs of similar size.
    """
    out: list[tuple[str, str, int] | None] = [None] * len(pairs)
    todo = []
    for k, (target, query) in enumerate(pairs):
        if target == query:
            out[k] = (target, query, 0) if most is None or most >= 0 else None
        elif not (target.isascii() and query.isascii()):  # letters of several bytes: one by one
            out[k] = (align_left if left else affine_align)(target, query, mismatch=mismatch, opening=opening, extending=extending, most=most)
        else:
            t, q = (target[::-1], query[::-1]) if left else (target, query)
            top = min(len(t), len(q))
            a, b = np.frombuffer(t.encode(), np.uint8), np.frombuffer(q.encode(), np.uint8)
            differ = np.flatnonzero(a[len(a) - top :][::-1] != b[len(b) - top :][::-1])
            same = int(differ[0]) if len(differ) else top
            todo.append((len(t) - same, len(q) - same, k, t, q))
    todo.sort(key=lambda x: (max(x[0], x[1]), x[2]))
    while todo:
        n = m = take = 0
        least = max(todo[0][0], todo[0][1])
        for x in todo:
            n, m = max(n, x[0]), max(m, x[1])
            if take and ((n + 1) * (m + 1) * (take + 1) > CELLS or max(n, m) > least + least // 8 + 4):
                break
            take += 1
        now, todo = todo[:take], todo[take:]
        how, cost = _tables([(t[:i].encode(), q[:j].encode()) for i, j, _, t, q in now], mismatch, opening, extending)
        for at, (i, j, k, t, q) in enumerate(now):
            if most is not None and cost[at] > most:
                continue
            a, b = [t[i:][::-1]], [q[j:][::-1]]
            moves, held = np.ascontiguousarray(how[: i + 1, : j + 1, at]).tobytes(), 0
            wide = j + 1
            while i or j:
                here = moves[i * wide + j]
                move = 2 if i == 0 else 1 if j == 0 else held or here & 3
                held = 0 if move == 0 else move if here & (4 if move == 1 else 8) else 0
                if move != 2:
                    i -= 1
                if move != 1:
                    j -= 1
                a.append("-" if move == 2 else t[i]), b.append("-" if move == 1 else q[j])
            # gathered from the end back, so as they are in the order of ``left``
            both = "".join(a), "".join(b)
            out[k] = (*(both if left else (x[::-1] for x in both)), int(cost[at]))
    return out


def align_left(target: str, query: str, padding: str = "", **how) -> tuple[str, str, int] | None:
    """Aligns the reversed strings, so that gaps among equal letters come to lie leftmost; ``padding`` goes before both."""
    got = affine_align((padding + target)[::-1], (padding + query)[::-1], **how)
    return got and (got[0][::-1], got[1][::-1], got[2])


def pair_map(aligned_target: str, aligned_query: str) -> list[tuple[int, int, str]]:
    """(target position, query position, M, X, I or D) of each column of two aligned strings."""
    out, t, q = [], 0, 0
    for a, b in zip(aligned_target, aligned_query):
        out.append((t, q, "I" if a == "-" else "D" if b == "-" else "M" if a == b else "X"))
        t, q = t + (a != "-"), q + (b != "-")
    return out


def variants(columns: list[tuple[int, int, str]], target: str, query: str) -> list[tuple[int, int, str, str, str]]:
    """Runs of columns that aren't matches as (target position, query position, kind, target part, query part).

    A run with parts of equal length is X and placed at its first base; otherwise it is I if the target part is longer, D if it is
    shorter, and both parts begin with the match before the run.
    """
    out, last, run = [], (0, 0, "-", "-"), []

    def close() -> None:
        if run:
            a, b = "".join(target[t] for t, _, o in run if o != "I"), "".join(query[q] for _, q, o in run if o != "D")
            if len(a) == len(b):
                out.append((last[0] + 1, last[1] + 1, "X", a, b))
            else:
                out.append((last[0], last[1], "I" if len(a) > len(b) else "D", last[2] + a, last[3] + b))
            run.clear()

    for t, q, o in columns:
        if o == "M":
            close()
            last = (t, q, target[t], query[q])
        else:
            run.append((t, q, o))
    close()
    return out


def edit_map(target: str, query: str, most: int | None = None) -> list[tuple[int, int, str]] | None:
    """The columns, as ``pair_map`` gives them, of an alignment with the fewest edits; None if there are more than ``most``.

    Myers' bit vectors over the whole query: one step a letter of the target, however long the query is.
    """
    n, m = len(target), len(query)
    every, top = (1 << m) - 1, m - 1
    peq: dict[str, int] = {}
    for j, c in enumerate(query):
        peq[c] = peq.get(c, 0) | 1 << j
    up, down, cost = every, 0, m
    ups, downs = [up], [down]  # differences to the cell above in the query, +1 and -1, behind each letter of the target
    for i, c in enumerate(target):
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & every, up & xh
        if m:
            cost += (ph >> top & 1) - (mh >> top & 1)
        else:
            cost += 1
        if most is not None and cost - (n - 1 - i) > most:
            return None
        ph, mh = (ph << 1 | 1) & every, mh << 1 & every
        up, down = mh | ~(xv | ph) & every, ph & xv
        ups.append(up), downs.append(down)
    if most is not None and cost > most:
        return None
    out, i, j = [], n, m
    while i or j:
        if j and ups[i] >> j - 1 & 1:
            j -= 1
            out.append((i, j, "I"))
        elif i and j and target[i - 1] == query[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j, "M"))
        elif i and (not j or downs[i - 1] >> j - 1 & 1):
            i -= 1
            out.append((i, j, "D"))
        else:
            i, j = i - 1, j - 1
            out.append((i, j, "X"))
    return out[::-1]


def delta_encode(base: str, other: str, tolerance: float = 0.1, band: int = 32) -> list[tuple[str, int, int, str]] | None:
    """``other`` as copies (M, begin, end) of ``base`` and inserted letters (I); None if they are too different."""
    got = edit_map(base, other, 32 + int(tolerance * min(len(base), len(other))))
    if got is None:
        return None
    out: list[tuple[str, int, int, str]] = []
    for t, q, o in got:
        if o == "M":
            if out and out[-1][0] == "M" and out[-1][2] == t:
                out[-1] = ("M", out[-1][1], t + 1, "")
            else:
                out.append(("M", t, t + 1, ""))
        elif o in "XI":
            out.append(("I", 0, 0, other[q]))
    return out


def delta_decode(base: str, ops: list[tuple[str, int, int, str]]) -> str:
    return "".join(base[a:b] if o == "M" else c for o, a, b, c in ops)


def projected(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, t_at, same): the place in t_seq that is aligned with place ``at`` of q_seq, and whether both letters are equal.

    Null where the letter has no partner, or the sequences differ in more than 32 and a tenth of the shorter one.
    """
    form = StructType([*(pairs.schema[k] for k in keep), StructField("t_at", IntegerType()), StructField("same", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, same = [], []
            for t, q, at in zip(*(b.column(c).to_pylist() for c in range(3))):
                got = None if t is None or q is None else edit_map(t, q, 32 + min(len(t), len(q)) // 10)
                found = next(((i, o == "M") for i, j, o in got or () if j == at and o in "MX"), (None, None))
                places.append(found[0]), same.append(found[1])
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(places, pa.int32()), pa.array(same, pa.bool_())], [*keep, "t_at", "same"])

    return pairs.select("t_seq", "q_seq", "at", *keep).mapInArrow(run, form)


def delta_coded(pairs: DataFrame, base: str, other: str, keep: list[str]) -> DataFrame:
    """(keep, coded, raw): ``other`` as operations on ``base``; where they differ too much it is kept as it is, in ``raw``."""
    form = StructType([*(pairs.schema[k] for k in keep), StructField("coded", ArrayType(_OPS)), StructField("raw", StringType())])
    kind = pa.list_(pa.struct([("op", pa.string()), ("bgn", pa.int32()), ("end", pa.int32()), ("letter", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                seqs = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                got = [None if x is None or y is None else delta_encode(x, y) for x, y in seqs]
                coded = [None if g is None else [dict(zip(("op", "bgn", "end", "letter"), o)) for o in g] for g in got]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(coded, kind), pa.array([y if g is None else None for g, (_, y) in zip(got, seqs)], pa.string())], [*keep, "coded", "raw"])

    return pairs.select(base, other, *keep).mapInArrow(run, form)


def delta_restored(base: Column, coded: Column, raw: Column) -> Column:
    """The sequence from its operations on ``base``, or as it was kept."""
    part = lambda o: F.when(o["op"] == "M", F.substring(base, o["bgn"] + 1, o["end"] - o["bgn"])).otherwise(o["letter"])
    return F.coalesce(raw, F.array_join(F.transform(coded, part), ""))


def aligned(pairs: DataFrame, most: int | None = 384, left: bool = True) -> DataFrame:
    """Adds aligned_t, aligned_q and cost to pairs with (t_seq, q_seq); nulls where the cost is above ``most``.

    Alignment needs memory of the product of the lengths: give it segments between anchors, not whole contigs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j = b.schema.get_field_index("t_seq"), b.schema.get_field_index("q_seq")
            seqs = list(zip(b.column(i).to_pylist(), b.column(j).to_pylist()))
            there = [k for k, (t, q) in enumerate(seqs) if t is not None and q is not None]
            done = dict(zip(there, affine_many([seqs[k] for k in there], most=most, left=left)))
            got = [done.get(k) for k in range(len(seqs))]
            extra = [pa.array([g[0] if g else None for g in got], pa.string()), pa.array([g[1] if g else None for g in got], pa.string()), pa.array([g[2] if g else None for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "aligned_t", "aligned_q", "cost"])

    form = pairs.schema
    form = StructType([*form.fields, StructField("aligned_t", StringType()), StructField("aligned_q", StringType()), StructField("cost", IntegerType())])
    return pairs.mapInArrow(run, form)


def variant_rows(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t_pos, q_pos, kind, t_str, q_str): variants of aligned pairs (t_seq, q_seq, aligned_t, aligned_q)."""

    def found(t, q, at, aq):
        return [] if at is None else variants(pair_map(at, aq), t, q)

    kind = "array<struct<t_pos: int, q_pos: int, kind: string, t_str: string, q_str: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("t_pos", pa.int32()), ("q_pos", pa.int32()), ("kind", pa.string()), ("t_str", pa.string()), ("q_str", pa.string())]))
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("t_seq", "q_seq", "aligned_t", "aligned_q")))
            lists = [[dict(zip(("t_pos", "q_pos", "kind", "t_str", "q_str"), v)) for v in found(*r)] for r in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(lists, item)], [*keys, "v"])

    form = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "t_seq", "q_seq", "aligned_t", "aligned_q").mapInArrow(run, f"{form}, v {kind}").select(*keys, F.explode("v").alias("v")).select(*keys, "v.*")


def alignment_columns(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, t_pos, q_pos, op): the columns of aligned strings, with positions as running counts of letters."""
    chars = F.transform(F.sequence(F.lit(1), F.length("aligned_t")), lambda i: F.struct(F.substring(F.col("aligned_t"), i, F.lit(1)).alias("t"), F.substring(F.col("aligned_q"), i, F.lit(1)).alias("q")))
    cols = pairs.where("length(aligned_t) > 0").select(*keys, F.posexplode(chars).alias("col", "c"))
    before = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum((F.col(c) != "-").cast("int")).over(before), F.lit(0))
    op = F.when(F.col("c.t") == "-", "I").when(F.col("c.q") == "-", "D").when(F.col("c.t") == F.col("c.q"), "M").otherwise("X")
    return cols.select(*keys, "col", count("c.t").alias("t_pos"), count("c.q").alias("q_pos"), op.alias("op"))
