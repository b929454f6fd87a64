"""Sparse chaining of anchor matches, and the regions that chains give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.operators.grouped import grouped_scan
from strandframe.operators.overlap import merge_regions

ANCHOR = ("q_bgn", "q_end", "q_orientation", "bgn", "end_pos", "orientation")
f32 = np.float32


def chain(anchors: list[tuple[int, ...]], max_span: int = 8, penalty: float = 0.025, max_gap: int | None = None, oriented: bool = False) -> list[tuple[float, list[tuple[int, ...]]]]:
    """Chains of anchors (q_bgn, q_end, q_orientation, bgn, end, orientation) with their scores, best first.

    An anchor extends the best of those before it: its length is added and the gaps on both axes cost ``penalty``.
    At most ``max_span`` different query intervals before it are looked at. Chains are taken from the best remaining
    end back to an anchor that is taken already; a chain's score is the gain over its first anchor.
    """
    a = sorted(set(anchors))
    rate = f32(penalty)
    score = np.zeros(len(a), f32)
    back = [-1] * len(a)
    for i, (qb, qe, qo, tb, te, to) in enumerate(a):
        length, top, same = f32(qe - qb), f32(0), qo == to
        looked: set[tuple] = set()
        for j in range(i - 1, -1, -1):
            pqb, pqe, pqo, ptb, pte, pto = a[j]
            if oriented and (pqo ^ pto) != (qo ^ to) or (pqb, pqe, pqo) == (qb, qe, qo):
                continue
            gap_q, gap_t = abs(qb - pqe), abs(tb - pte) if same else abs(te - ptb)
            if max_gap is not None and max(gap_q, gap_t) > max_gap:
                continue
            looked.add((pqb, pqe, pqo))
            s = score[j] + length - rate * f32(gap_q + gap_t)
            if s > top:
                top, back[i] = s, j
            if len(looked) >= max_span:
                break
        score[i] = top if back[i] >= 0 else length
    out, free = [], [True] * len(a)
    for last in sorted(range(len(a)), key=lambda i: (-score[i], a[i])):
        if free[last] and score[last] > 0:
            track, v = [], last
            while v >= 0 and free[v]:
                free[v] = False
                track.append(v)
                v = back[v]
            track.reverse()
            out.append((float(score[last] - score[track[0]]), [a[v] for v in track]))
    return out


def sparse_chains(hits: DataFrame, max_span: int = 8, penalty: float = 0.025, max_gap: int | None = None, oriented: bool = False) -> DataFrame:
    """(q_sid, sid, chain, score, ord, anchor columns): chains of each query and target with more than one hit.

    ``hits`` is what ``suppressed_hits`` gives; chains are numbered from 0, the best first.
    """

    def work(key: tuple, rows: list[dict]):
        if len(rows) < 2:
            return
        for c, (score, track) in enumerate(chain([tuple(r[k] for k in ANCHOR) for r in rows], max_span, penalty, max_gap, oriented)):
            for o, anchor in enumerate(track):
                yield (*key, c, score, o, *anchor)

    ids = ", ".join(f"{c} {hits.schema[c].dataType.simpleString()}" for c in ("q_sid", "sid"))
    form = f"{ids}, chain int, score float, ord int, " + ", ".join(f"{c} int" for c in ANCHOR)
    return grouped_scan(hits.select("q_sid", "sid", *ANCHOR), ["q_sid", "sid"], list(ANCHOR), work, form)


def chain_ranges(chains: DataFrame, least: int = 3, per_chain: bool = False) -> DataFrame:
    """(q_sid, sid, chain, n, score, q_bgn, q_end, bgn, end_pos, orientation): extent of each chain of at least ``least`` anchors.

    Orientation is 0 if more anchors agree than disagree, counted over this and the earlier chains of the target, or
    with ``per_chain`` over this one alone.
    """
    turned = (F.col("q_orientation") != F.col("orientation")).cast("int")
    by = chains.groupBy("q_sid", "sid", "chain").agg(
        F.count("*").alias("n"), F.first("score").alias("score"), F.min("q_bgn").alias("q_bgn"), F.max("q_end").alias("q_end"),
        F.min("bgn").alias("bgn"), F.max("end_pos").alias("end_pos"), F.sum(turned).alias("r"), F.sum(1 - turned).alias("f"),
    ).where(F.col("n") >= least)
    w = Window.partitionBy("q_sid", "sid").orderBy("chain").rowsBetween(Window.unboundedPreceding, 0)
    f, r = (F.col("f"), F.col("r")) if per_chain else (F.sum("f").over(w), F.sum("r").over(w))
    return by.withColumn("orientation", F.when(f > r, 0).otherwise(1)).drop("f", "r")


def query_regions(ranges: DataFrame, tolerance: int = 100_000) -> DataFrame:
    """(q_sid, sid, orientation, bgn, end_pos, length, n, anchors, q_bgn, q_end): target regions of each query, merged per orientation."""
    more = (F.sum(F.col("n").cast("long")).alias("anchors"), F.min("q_bgn").alias("q_bgn"), F.max("q_end").alias("q_end"))
    return merge_regions(ranges, ["q_sid", "sid", "orientation"], tolerance, *more)


def hit_summary(ranges: DataFrame) -> DataFrame:
    """(q_sid, sid, q_bgn, q_end, bgn, end_pos, n_hits, reversed): one row per query and target."""
    return ranges.groupBy("q_sid", "sid").agg(
        F.min("q_bgn").alias("q_bgn"), F.max("q_end").alias("q_end"), F.min("bgn").alias("bgn"), F.max("end_pos").alias("end_pos"),
        F.sum("n").alias("n_hits"), F.max("orientation").alias("reversed"),
    )


def strong_hits(summary: DataFrame, least: int = 100, share: float = 0.6) -> DataFrame:
    """Summaries with more than ``least`` hits whose target part is longer than ``share`` of the query part."""
    return summary.where((F.col("n_hits") > least) & ((F.col("end_pos") - F.col("bgn")) > share * (F.col("q_end") - F.col("q_bgn"))))


def best_target(ranges: DataFrame, weight: Column | None = None) -> DataFrame:
    """(q_sid, sid, total): the target with the largest summed hit length of each query; ties go to the smaller sid."""
    w = weight if weight is not None else F.col("q_end") - F.col("q_bgn")
    total = ranges.groupBy("q_sid", "sid").agg(F.sum(w).alias("total"))
    return total.groupBy("q_sid").agg(F.max(F.struct("total", (-F.col("sid")).alias("neg"))).alias("b")).select("q_sid", (-F.col("b.neg")).alias("sid"), F.col("b.total").alias("total"))


def largest_block(ranges: DataFrame) -> DataFrame:
    """(q_sid, sid, q_bgn, q_end): the largest chain of each query; ties go to the smaller sid and begin."""
    size = F.col("q_end") - F.col("q_bgn")
    best = F.max(F.struct(size.alias("s"), (-F.col("sid")).alias("a"), (-F.col("q_bgn")).alias("b"))).alias("m")
    return ranges.groupBy("q_sid").agg(best).select("q_sid", (-F.col("m.a")).alias("sid"), (-F.col("m.b")).alias("q_bgn"), (F.col("m.s") - F.col("m.b")).alias("q_end"))


def forward_steps(anchors: list[tuple[int, int, int, int, bool]], reverse: bool) -> list[tuple[int, int, int, int]]:
    """(ts, te, qs, qe): steps that tile a chain from end to end. anchors: (q_bgn, q_end, bgn, end, agrees), in order of the query.

    The first anchor is a step. Then each anchor in the orientation of the chain that begins on the target behind the last
    step's end (in reverse also at it) ends a step that goes on from there; in reverse the query is walked backward.
    """
    rows = anchors[::-1] if reverse else anchors
    qs, qe, ts, te, _ = rows[0]
    out = [(ts, te, qs, qe)]
    for qb, qend, b, e, agrees in rows:
        if e >= b and agrees != reverse and (b >= te if reverse else b > te) and e != te:
            qs, qe = (qb, qs) if reverse else (qe, qend)
            out.append((te, e, qs, qe))
            te = e
    return out


def mapped_intervals(positions: DataFrame) -> DataFrame:
    """(q_sid, name, sid, bgn, end_pos, orientation): intervals of which both ends map exactly once, to one target in one orientation.

    ``positions`` has (q_sid, name, side 0 or 1, sid, pos, orientation), one row per place to which an end maps.
    """
    by = ["q_sid", "name", "sid"]
    once = positions.groupBy(*by, "side").agg(F.count("*").alias("n"), F.first("pos").alias("pos"), F.first("orientation").alias("o")).where("n = 1")
    both = once.groupBy(*by).agg(F.count("*").alias("n"), F.min("pos").alias("bgn"), F.max("pos").alias("end_pos"), F.min("o").alias("o"), F.max("o").alias("o2"))
    return both.where("n = 2 AND o = o2").select(*by, "bgn", "end_pos", F.col("o").alias("orientation"))
