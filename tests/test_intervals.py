"""Merging, joins and tiling of intervals against slow versions."""

from __future__ import annotations

import random

from helpers import rows
from hypothesis import given, settings, strategies as st
import numpy as np
import pytest

from strandframe.operators import overlap as V
from strandframe.operators.intervals_merge import combine_summaries, fold_sorted, merge_intervals


def slow_merge(data):
    out = []
    by = {}
    for e, b, x in data:
        if e is not None and b is not None and x is not None and b < x:
            by.setdefault(e, []).append((b, x))
    for e, own in by.items():
        islands = []
        for b, x in sorted(own):
            if islands and b <= islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], x)
            else:
                islands.append([b, x])
        out += [(e, "merged", b, x) for b, x in islands]
        out += [(e, "gap", p[1], q[0]) for p, q in zip(islands, islands[1:])]
    return sorted(out)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 50), st.integers(1, 20)), max_size=60))
@settings(max_examples=100, deadline=None)
def test_fold_matches_a_loop(data):
    data = sorted((g, b, b + n) for g, b, n in data)
    g, b, e = (np.array([d[i] for d in data], np.int64) for i in range(3))
    first, s, t = fold_sorted(g, b, e)
    assert sorted((int(g[f]), "merged", int(x), int(y)) for f, x, y in zip(first, s, t)) == [r for r in slow_merge(data) if r[1] == "merged"]


def test_fold_survives_huge_numbers():
    g, b, e = np.array([0, 0, 1]), np.array([-(2**62), 5, 0]), np.array([2**62, 6, 1])
    assert [x.tolist() for x in fold_sorted(g, b, e)[1:]] == [[-(2**62), 0], [2**62, 1]]


def test_summaries_carry_a_long_interval_over_partitions():
    carried, last = combine_summaries([(0, "a", 0, 100), (1, "a", 50, 60), (3, "a", 99, 120), (4, "b", 1, 2)])
    assert carried == {0: None, 1: ("a", 0, 100), 3: ("a", 0, 100), 4: ("a", 0, 120)} and last == 4


def test_merge_with_a_hot_entity(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.5 else f"c{rnd.randrange(5)}", b := rnd.randrange(20_000), b + rnd.randrange(-2, 30)) for _ in range(5000)]
    data += [("hot", 0, 5000), ("hot", 0, 5000), (None, 1, 2), ("c1", None, 2), ("c1", 1, None), ("c2", 9, 9)]
    df = spark.createDataFrame(data, "ctg string, bgn int, end_pos int").repartition(7)
    assert rows(merge_intervals(df, "ctg", "bgn", "end_pos")) == slow_merge(data)


def test_merge_of_nothing_and_with_clashing_columns(spark):
    empty = spark.createDataFrame([], "ctg string, bgn int, end_pos int")
    assert rows(merge_intervals(empty, "ctg", "bgn", "end_pos")) == []
    odd = spark.createDataFrame([("a", 1, 3, "x", 7), ("a", 3, 4, "y", 8)], "ctg string, s int, e int, kind string, entity int")
    assert rows(merge_intervals(odd, "ctg", "s", "e")) == [("a", "merged", 1, 4)]


@pytest.mark.parametrize("how", ["inner", "semi", "anti"])
def test_overlap_join(spark, how):
    rnd = random.Random(how)
    a = [(i, rnd.choice("xy"), b := rnd.randrange(100), b + rnd.randrange(0, 40)) for i in range(60)]
    b = [(i, rnd.choice("xy"), s := rnd.randrange(100), s + rnd.randrange(0, 9)) for i in range(40)]
    met = {(p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < q[3] and q[2] < p[3] and p[2] < p[3] and q[2] < q[3]}
    da, db = spark.createDataFrame(a, "i int, chr string, bgn int, end_pos int"), spark.createDataFrame(b, "j int, chr string, b_bgn int, b_end int")
    got = V.overlap_join(da, db, how, width=8)
    if how == "inner":
        assert rows(got, "i", "j") == sorted(met)
    else:
        inside = {i for i, _ in met}
        assert rows(got, "i") == sorted((p[0],) for p in a if (p[0] in inside) == (how == "semi"))


def test_points_and_brackets(spark):
    iv = spark.createDataFrame([("x", 0, 10, "a"), ("x", 5, 7, "b"), ("x", 10, 10, "c")], "chr string, b_bgn int, b_end int, n string")
    pts = spark.createDataFrame([("x", 5), ("x", 9), ("x", 10), (None, 5)], "chr string, pos int")
    assert rows(V.point_join(pts, iv, 4), "pos", "n") == [(5, "a"), (5, "b"), (9, "a")]
    anchors = iv.selectExpr("chr", "b_bgn q_bgn", "b_end q_end")
    assert rows(V.brackets(pts.where("chr = 'x'"), anchors, ["chr"])) == [("x", 5, 0, 7), ("x", 9, 5, 10), ("x", 10, 5, None)]


def test_regions_tiling_and_groups(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 12, 13), ("a", 2, 4), ("a", 40, 50)], "t string, bgn int, end_pos int")
    assert rows(V.merge_regions(df, ["t"], 5)) == [("a", 0, 13, 13, 3), ("a", 40, 50, 10, 1)]
    assert rows(V.merge_regions_summed(df, ["t"], 5)) == [("a", 0, 13, 11, 2), ("a", 40, 50, 10, 1)]
    blocks = spark.createDataFrame([("a", 0, 10, 1), ("a", 2, 4, 2), ("a", 8, 12, 3), ("a", 20, 30, 4)], "t_name string, ts int, te int, block_id int")
    tiles = [("a", "D", 2, 4, 2), ("a", "G", 12, 20, 4), ("a", "O", 0, 0, 1), ("a", "O", 8, 10, 3)]
    assert rows(V.tiling(blocks)) == tiles
    lengths = spark.createDataFrame([("a", 35), ("b", 9)], "t_name string, len int")
    assert rows(V.tiling(blocks, lengths=lengths)) == sorted([*tiles, ("a", "G", 30, 35, None)], key=str)
    assert rows(V.layout_offsets(spark.createDataFrame([(f"n{i:03}", 500 - i) for i in range(300)], "name string, length int"), 10), "name", "offset") == [(f"n{i:03}", sum(510 - j for j in range(i))) for i in range(300)]
    v = spark.createDataFrame([("a", 0, 10, "A", "C"), ("a", 1, 2, "A", "G"), ("a", 5, 1, "A", "C"), ("a", 5, 1, "A", "C")], "t_name string, ts int, tl int, t_str string, q_str string")
    grouped = V.allele_numbers(V.variant_groups(v))
    assert rows(grouped, "ts", "grp", "allele") == [(0, 1, 1), (1, 1, 2), (5, 2, 1), (5, 2, 1)]
