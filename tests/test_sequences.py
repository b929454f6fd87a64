"""Sequences, marks, pairs, chains, alignment, graph, bundles and consensus: goldens, properties and slow versions."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from helpers import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandframe.functions import dna
from strandframe.operators import align as A, bundles as B, chains as H, consensus as K, graph as G, pairs as P, variants as X
from strandframe.operators.shimmers import ShimmerSpec, candidates, select, sequence_marks, shimmer_pairs, shimmers

MASK = (1 << 64) - 1


def bases(n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") for _ in range(n))


def back(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def slow_mix(key: int) -> int:
    key = ((key << 21) - key - 1) & MASK
    key ^= key >> 24
    key = (key + (key << 3) + (key << 8)) & MASK
    key ^= key >> 14
    key = (key + (key << 2) + (key << 4)) & MASK
    key ^= key >> 28
    return (key + (key << 31)) & MASK


def slow_candidates(seq: str, k: int):
    out, text = [], ""
    for p, c in enumerate(seq.upper()):
        if c in "ACGT":
            text += c
        kmer = text[-k:]
        if p < k or not kmer:
            continue
        code = ["ACGT".index(x) for x in kmer]
        planes = lambda v: tuple(sum(((x >> b) & 1) << i for i, x in enumerate(reversed(v))) for b in (0, 1))
        f = planes(code)
        r = planes([3 - x for x in reversed(code)]) if len(code) == k else tuple(sum((((3 - x) >> b) & 1) << (k - 1 - i) for i, x in enumerate(reversed(code))) for b in (0, 1))
        if f == r:
            continue
        use = r if r[0] < f[0] else f
        out.append((p, slow_mix(use[0]) ^ slow_mix(use[1] ^ 0xAD12CF59), int(r[0] < f[0])))
    return out


@pytest.mark.parametrize("k", [4, 5, 16, 31, 56])
def test_candidates(k):
    seq = bases(150, k) + "NN" + bases(60, k + 1).lower() + "ACGT" * 20
    pos, value, strand, _ = candidates(seq.encode(), k)
    assert list(zip(pos.tolist(), [int(v) for v in value], strand.tolist())) == slow_candidates(seq, k)


def slow_select(x, place, window, first, last):
    ring, out, d, low = [], [], 0, MASK
    for i, v in enumerate(x):
        ring = [*ring, i][-window:]
        if d == window - 1:
            low = min(x[j] for j in ring)
            same = [j for j in ring if x[j] == low]
            out += same
            d = place[i] - place[same[-1]]
        elif v <= low and first <= place[i] < last:
            out.append(i)
            low, d = v, 0
        else:
            d += 1
    return out


@given(st.lists(st.integers(0, 12), min_size=1, max_size=120), st.integers(2, 9), st.integers(0, 20), st.lists(st.integers(1, 3), min_size=120, max_size=120))
@settings(max_examples=200, deadline=None)
def test_jumping_selection_equals_the_ring(x, window, first, steps):
    place = np.cumsum(steps[: len(x)])
    got = select(np.array(x, np.uint64), place, window, first, int(place[-1]) - 1)
    assert got == slow_select(x, place.tolist(), window, first, int(place[-1]) - 1)


@pytest.mark.parametrize("sketch", [True, False])
def test_reverse_complement_gives_the_same_marks_backward(sketch):
    seq = bases(4000, 11)
    spec = ShimmerSpec(80, 56, 4 if not sketch else 2, 64, sketch)
    a, b = sequence_marks(seq.encode(), spec)[0].tolist(), sequence_marks(back(seq).encode(), spec)[0].tolist()
    assert a and (a == b[::-1] if sketch else len(set(a) & set(b)) >= len(a) - 2)


def test_padding_keeps_both_ends():
    spec = ShimmerSpec(24, 24, 12, 24, False)
    seq = bases(900, 5).encode()
    assert len(sequence_marks(seq, spec, True)[0]) >= 2 >= len(sequence_marks(seq[:200], spec)[0])
    assert [len(x) for x in sequence_marks(b"ACGT", spec)] == [0, 0, 0]
    with pytest.raises(ValueError):
        ShimmerSpec(k=57)


def test_columns(spark):
    df = spark.createDataFrame([(1, "ACgtN", "ID=a; K = b=c;ID=z;", -5802746841459543784, (3 << 32) | (70 << 1) | 1), (2, None, None, None, None)], "i int, s string, a string, x long, y long")
    r = df.select(dna.reverse_complement("s").alias("rc"), dna.subsequence("s", F.lit(1), F.lit(3)).alias("sub"), dna.attribute_map("a").alias("m"), dna.mark_hash("x").alias("h"), dna.mark_span("x").alias("sp"), dna.mark_rid("y").alias("rid"), dna.mark_pos("y").alias("pos"), dna.mark_strand("y").alias("st"), F.size(dna.kmers("s", 2)).alias("n"), dna.file_stem(F.lit("/a/b.c.fa")).alias("f"), dna.last_attribute(F.lit('gene_id "G"; gene_name "N1";')).alias("g")).first()
    ux = -5802746841459543784 & MASK
    assert (r.rc, r["sub"], r.m, r.h, r.sp, r.rid, r.pos, r.st, r.n, r.f, r.g) == ("NacGT", "Cg", {"K": "b=c", "ID": "z"}, ux >> 8, ux & 255, 3, 70, 1, 4, "b.c", "N1")
    packed = df.where("i = 1").select(dna.pack_mark(dna.mark_hash("x"), dna.mark_span("x"), dna.mark_rid("y"), dna.mark_pos("y"), dna.mark_strand("y")).alias("p"), "x", "y").first()
    assert (packed.p.x, packed.p.y) == (packed.x, packed.y)


SPEC = ShimmerSpec(20, 15, 1, 4, True)


@pytest.fixture(scope="module")
def family(spark):
    base = bases(1500, 21)
    data = [(0, "s0", base), (1, "s0", base[:700] + "T" + base[701:]), (2, "s1", base[200:]), (3, "s1", back(base)), (4, "s2", bases(800, 22)), (5, "s2", None), (6, "s2", "")]
    return spark.createDataFrame(data, "sid int, source string, seq string")


def test_pairs_and_their_relations(spark, family):
    pairs = shimmer_pairs(family, SPEC).cache()
    n = {}
    by = {}
    for r in pairs.collect():
        n[r.h0, r.h1] = n.get((r.h0, r.h1), 0) + 1
        by.setdefault((r.h0, r.h1), []).append(r)
        assert r.h0 <= r.h1
    assert {(r.h0, r.h1): r.n for r in P.pair_counts(pairs).collect()} == n
    h0, h1 = max(n, key=n.get)
    assert P.pair_count(pairs, h0, h1).first().n == n[h0, h1] and P.postings(pairs, h0, h1).count() == n[h0, h1]
    q = shimmer_pairs(family.where("sid = 2"), SPEC, query=True)
    want = sorted((r.sid, r.bgn, r.end_pos) for p in q.collect() for r in by.get((p.h0, p.h1), ()))
    assert sorted((r.sid, r.bgn, r.end_pos) for r in P.hits(q, pairs).where("sid IS NOT NULL").collect()) == want
    few = P.suppressed_hits(q, pairs, 3, 3, 1)
    assert few.count() == sum(len(by[k]) for p in q.collect() if (k := (p.h0, p.h1)) in by and n[k] <= 3 and len({r.sid for r in by[k]}) == len(by[k]))
    assert P.contained(shimmers(family, SPEC), shimmers(family.where("sid = 0"), SPEC)).select("sid").distinct().count() >= 3
    assert P.dots(shimmers(family.where("sid = 0"), SPEC), shimmers(family.where("sid = 2"), SPEC)).where("x - y = 200").count() > 20


def test_chaining_against_a_plain_dp():
    rnd = random.Random(1)
    anchors = [(i * 20, i * 20 + 15, 0, i * 20 + 300 + rnd.randrange(3), i * 20 + 315, 0) for i in range(30)] + [(100, 115, 0, 5000, 5015, 0), (100, 115, 0, 5000, 5015, 0)]
    chains = H.chain(anchors, penalty=0.1)
    assert len(chains[0][1]) == 30 and sum(len(c) for _, c in chains) == 31
    assert chains[0][0] == pytest.approx(sum(15 - 0.1 * (5 + abs(b[3] - a[4])) for a, b in zip(chains[0][1], chains[0][1][1:])), rel=1e-4)
    assert H.chain([(0, 5, 0, 0, 5, 0), (5, 9, 0, 5, 9, 1)], oriented=True) == [(0.0, [(0, 5, 0, 0, 5, 0)]), (0.0, [(5, 9, 0, 5, 9, 1)])]


def test_query_regions_find_the_family(spark, family):
    pairs = shimmer_pairs(family, SPEC)
    q = shimmer_pairs(family.where("sid = 2"), SPEC, query=True)
    ranges = H.chain_ranges(H.sparse_chains(P.suppressed_hits(q, pairs)))
    regions = {r.sid: r for r in H.query_regions(ranges, 100).collect()}
    assert set(regions) == {0, 1, 2, 3} and regions[3].orientation == 1 and regions[0].orientation == 0
    assert regions[0].bgn >= 200 and regions[0].length > 1000
    assert H.best_target(ranges).count() == 1 and H.largest_block(ranges).count() == 1 and H.hit_summary(ranges).count() == 4


def test_affine_alignment_is_optimal_and_restores():
    rnd = random.Random(3)
    for _ in range(60):
        t = bases(rnd.randrange(0, 25), rnd.random())
        q = bases(rnd.randrange(0, 25), rnd.random())
        a, b, cost = A.affine_align(t, q)
        assert a.replace("-", "") == t and b.replace("-", "") == q and cost == slow_affine(t, q)
        v = A.variants(A.pair_map(a, b), t, q)
        assert bool(v) == (t != q)
        assert A.delta_decode(t, A.delta_encode(t, q, 5.0)) == q
    assert A.affine_align("AAAA" * 20, "CCCC" * 20, most=10) is None


def slow_affine(t, q, x=3, o=3, e=1):
    big = 10**9
    m = {(0, 0): 0}
    g = {}
    for i in range(len(t) + 1):
        for j in range(len(q) + 1):
            d = min(m.get((i - 1, j), big) + o + e, g.get(("d", i - 1, j), big) + e)
            r = min(m.get((i, j - 1), big) + o + e, g.get(("r", i, j - 1), big) + e)
            g["d", i, j], g["r", i, j] = d, r
            if i or j:
                m[i, j] = min(d, r, m.get((i - 1, j - 1), big) + (0 if i and j and t[i - 1] == q[j - 1] else x) if i and j else big)
    return m[len(t), len(q)]


def test_whole_sequences_are_coded(spark, tmp_path):
    from strandframe.plans import kernels

    rnd = random.Random(5)
    letters = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    for _ in range(200):
        a, b = (letters(rnd.randint(0, 14)) for _ in range(2))
        got = A.edit_map(a, b)
        assert sum(o != "M" for _, _, o in got) == A.affine_align(a, b, 1, 0, 1)[2]
        assert (A.edit_map(a, b, 4) is None) == (sum(o != "M" for _, _, o in got) > 4)
        assert A.delta_decode(a, A.delta_encode(a, b, 1.0)) == b
    first = letters(1500)
    other = first[:700] + "ACGTT" + first[705:1200] + first[1203:]
    made = [(1, "n1", "s", first), (2, "n2", "s", other)]
    spark.createDataFrame(made, "sid int, name string, source string, seq string").write.parquet(str(tmp_path / "sequences.parquet"))
    assert rows(kernels.delta_roundtrip(spark, str(tmp_path))) == [(1, first), (2, other)]
    far = letters(1500)
    coded = A.delta_coded(spark.createDataFrame([(1, first, other), (2, first, far), (3, first, None)], "sid int, base string, seq string"), "base", "seq", ["sid"])
    assert [(r.sid, r.coded is not None, r.raw) for r in coded.orderBy("sid").collect()] == [(1, True, None), (2, False, far), (3, False, None)]


def test_golden_alignment_of_two_fragments():
    t = "TCCATTCCCACCAGCAGTGTGTGAAAGTCTGGTACTGGTTCAGCCTGCCGTACTTTAATGATTATTGGTGTCACTCTTTCAAGTAACTTGTTGGTAATAAGAAGTCAATTA"
    q = "TCCATTCCCACCAGCAGTGTGTGAAGGTTCAGCCTGCCGTACTTTAATGATTATTGGTGACACTCTTTCAAGTAACTTGTTGGTAATATTTATCTAAGAAGTCAATTA"
    a, b, _ = A.align_left(t, q)
    assert b == "TCCATTCCCACCAGCAGTGTGTGAA-----------GGTTCAGCCTGCCGTACTTTAATGATTATTGGTGACACTCTTTCAAGTAACTTGTTGGTAATATTTATCTAAGAAGTCAATTA" and a.count("-") == 8


def test_greedy_overlap():
    s = bases(600, 4)
    whole = A.greedy_overlap(s.encode(), s.encode())
    assert (whole["distance"], whole["end0"], whole["size"]) == (0, 600, 600)
    edited = s[:200] + s[203:400] + "A" + s[400:]
    got = A.greedy_overlap(s.encode(), edited.encode(), 0.1, 32, 8)
    assert got and 0 < got["distance"] <= 8 and A.greedy_overlap(s.encode(), bases(600, 99).encode(), 0.01) is None


@given(st.text("AC", max_size=24), st.text("AC", max_size=24))
@settings(max_examples=200, deadline=None)
def test_greedy_overlap_spends_the_fewest_letters(a, b):
    far = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                far[i, j] = min(far.get((i - 1, j), 99) + 1, far.get((i, j - 1), 99) + 1, far[i - 1, j - 1] if i and j and a[i - 1] == b[j - 1] else 99)
    got = A.greedy_overlap(a.encode(), b.encode(), 1.0, 10_000)
    assert got["distance"] == min(c for (i, j), c in far.items() if i == len(a) or j == len(b))
    assert all(a[x : x + n] == b[y : y + n] for x, y, n in got["runs"]) and far[got["end0"], got["end1"]] == got["distance"]
    steps = [(p[0] + p[2], p[1] + p[2], q[0], q[1]) for p, q in zip(got["runs"], got["runs"][1:])]
    assert all((c - x, d - y) in ((0, 1), (1, 0)) for x, y, c, d in steps)


def test_alignment_columns_match_the_kernel(spark):
    df = spark.createDataFrame([(1, "ACGTT", "ACTTA"), (2, "", ""), (3, None, "A")], "i int, t_seq string, q_seq string")
    al = A.aligned(df)
    r = al.where("i = 1").first()
    assert [tuple(x)[2:] for x in A.alignment_columns(al, ["i"]).orderBy("col").collect()] == A.pair_map(r.aligned_t, r.aligned_q)
    assert {x.i for x in al.where("aligned_t IS NULL").collect()} == {3} and {x.i for x in A.variant_rows(al, ["i"]).collect()} == {1}


def test_edges_components_and_bundles(spark, family):
    pairs = shimmer_pairs(family, SPEC).cache()
    links = P.edges(pairs)
    got = links.collect()
    assert {(r.w_h0, r.w_h1, 1 - r.w_ori, r.v_h0, r.v_h1, 1 - r.v_ori) for r in got} == {(r.v_h0, r.v_h1, r.v_ori, r.w_h0, r.w_h1, r.w_ori) for r in got}
    found = G.bundle_ids(G.principal_bundles(links, P.pair_counts(pairs), 3)).cache()
    assert found.count() == found.select("h0", "h1").distinct().count()
    placed = B.decompose(pairs, B.vertex_map(found))
    votes = B.bundle_votes(placed)
    turned = B.orient_bundles(found, votes)
    assert turned.count() == found.count() and rows(turned.groupBy("bundle_id").agg(F.max("pos")).select(F.lit(1))) == rows(found.groupBy("bundle_id").agg(F.max("pos")).select(F.lit(1)))
    assert B.bundle_runs(B.decompose(pairs, B.vertex_map(turned)), 100, 500).count() > 0
    order = G.weighted_order(links, P.pair_counts(pairs))
    assert order.count() == order.select("h0", "h1").distinct().count() == links.select("v_h0", "v_h1").distinct().count()


def test_components(spark):
    rnd = random.Random(2)
    e = [(f"{rnd.randrange(40):02}", f"{rnd.randrange(40):02}") for _ in range(25)] + [("x", "x")]
    name = {n: n for p in e for n in p}
    for _ in name:
        for a, b in e:
            name[a] = name[b] = min(name[a], name[b])
    assert rows(G.components(spark.createDataFrame(e, "a string, b string"))) == sorted(name.items())


def test_weighted_walk_prefers_heavy_neighbours():
    a, b, c, d = ((i, i, 0) for i in range(4))
    links = [(a, b), (a, c), (c, d)]
    links += [(G.flip(w), G.flip(v)) for v, w in links]
    walk = list(G.weighted_walk(*G._graph(links), {v: n for n, x in enumerate((a, b, c, d)) for v in (x, G.flip(x))}, a))
    assert [(w[0], w[2], w[4]) for w in walk] == [(a, False, 0), (c, False, 0), (d, True, 0), (b, True, 1)] and [w[3] for w in walk] == [1, 2, 3, 2]


def test_bundle_distance_and_linkage(spark):
    q = [(0, 100, 1, 0), (100, 200, 2, 0), (200, 300, 3, 1)]
    assert B.align_bundles(q, q)[0] == 0 and 0 < B.align_bundles(q, q[:1] + q[2:])[0] < 1
    seg = spark.createDataFrame([(c, *s) for c in ("a", "b") for s in q] + [("c", 0, 50, 9, 0), (None, 1, 2, 3, 0)], "ctg string, bgn int, end_pos int, b_id int, b_direction int")
    d = {(r.a, r.b): r.distance for r in B.bundle_distances(seg, seg.select("ctg").distinct()).collect()}
    assert d["a", "b"] == 0 and d["a", "c"] > 0.5
    merges, tree = B.average_linkage(["a", "b", "c"], d)
    assert merges[0][:2] == (0, 1) and merges[1][3] == 3 and tree.startswith("(") and tree.endswith(");")
    assert B.average_linkage([], {}) == ([], ";")
    assert rows(B.bundle_offsets(seg, "a"), "ctg", "offset")[:2] == [("a", 0), ("b", 0)]


def test_distances_of_many_and_of_queries_to_all(spark):
    rnd = random.Random(3)
    lists = [[(p * 100, p * 100 + rnd.randint(1, 90), rnd.randint(1, 4), rnd.randint(0, 1)) for p in range(rnd.randint(1, 9))] for _ in range(60)]
    got = B.block_distances(lists[:20], lists)
    assert all(got[i, j] == max(B.align_bundles(q, t)[0], B.align_bundles(t, q)[0]) for i, q in enumerate(lists[:20]) for j, t in enumerate(lists))
    seg = spark.createDataFrame([(f"c{k}", *x) for k, own in enumerate(lists) for x in own], "ctg string, bgn int, end_pos int, b_id int, b_direction int")
    asked = seg.where("ctg IN ('c3', 'c7')").select("ctg")
    d = {(r.a, r.b): r.distance for r in B.bundle_distances(seg, asked, seg.select("ctg")).collect()}
    assert len(d) == 2 * 60 and all(d[f"c{i}", f"c{j}"] == got[i, j] for i in (3, 7) for j in range(60))
    assert B.bundle_distances(seg, seg.select("ctg")).count() == 60 * 61 // 2


def test_distances_of_long_lists_pair_by_pair_of_blocks(spark, monkeypatch):
    rnd = random.Random(8)
    lists = [[(p * 100, p * 100 + rnd.randint(1, 90), rnd.randint(1, 9), 0) for p in range(rnd.randint(100, 130))] for _ in range(48)]
    began = time.process_time()
    got = B.block_distances(lists, lists)
    assert time.process_time() - began < 25  # 3 s; 109 s when each query met its targets alone
    assert all(got[i, j] == max(B.align_bundles(lists[i], lists[j])[0], B.align_bundles(lists[j], lists[i])[0]) for i, j in ((0, 1), (5, 40)))
    monkeypatch.setattr(B, "BLOCK", 500)  # stretches: about four contigs a block
    seg = spark.createDataFrame([(f"c{k}", *x) for k, own in enumerate(lists) for x in own], "ctg string, bgn int, end_pos int, b_id int, b_direction int")
    found = B.bundle_distances(seg, seg.select("ctg")).collect()
    assert len(found) == 48 * 49 // 2 and all(r.a <= r.b and r.distance == got[int(r.a[1:]), int(r.b[1:])] for r in found)


def test_distances_of_contigs_longer_than_32_bits():
    lists = [[(0, 1 << 30, 1, 0), (0, 1 << 31, 2, 0)], [(0, (1 << 31) - 9, 2, 0)]]
    assert B.block_distances(lists, lists)[0, 1] == max(B.align_bundles(*lists)[0], B.align_bundles(*lists[::-1])[0])


def test_consensus_repairs_reads():
    true = bases(1200, 31)
    rnd = random.Random(5)

    def read():
        s = list(true)
        for i in rnd.sample(range(100, 1100), 4):
            s[i] = rnd.choice("ACGT")
        return "".join(s)

    reads = [true, *(read() for _ in range(7))]
    assert K.kmer_consensus(reads, 31, 2) == true
    assert true.startswith(K.guided_consensus(reads, 2)[0][:500]) or K.guided_consensus(reads, 2)[0][:500] in true
    parts = K.sparse_consensus(reads, 3)
    assert len(parts) == 1 and parts[0][0] in true and len(parts[0][0]) > 900 and len(parts[0][0]) == len(parts[0][1])
    assert all(len(s) == len(c) for s, c in K.branch_consensus(reads))
    with pytest.raises(ValueError):
        K.kmer_consensus(["ACGT" * 20], 5, 1)


def test_assembly_records_and_genotypes(spark):
    ref = bases(3000, 41)
    hap = ref[:900] + ("A" if ref[900] != "A" else "C") + ref[901:1500] + ref[1504:]
    seqs = spark.createDataFrame([(0, ref), (1, hap), (2, back(hap))], "sid int, seq string")
    spec = ShimmerSpec(32, 24, 1, 8, True)
    r, q = seqs.where("sid = 0"), seqs.where("sid > 0")
    segments = X.blocks(X.unique_chains(shimmer_pairs(q, spec, query=True), shimmer_pairs(r, spec)), spec.k).cache()
    records = X.alignment_records(segments, r, q)
    found = records.where("rec_type = 'V'").select("q_sid", (F.col("ts") + F.col("td")).alias("at"), "vt", "t_str", "q_str").distinct()
    assert {(x.q_sid, x.at, x.vt) for x in found.collect()} >= {(1, 900, "X"), (2, 900, "X")}
    assert found.where("vt = 'I'").select("q_sid").distinct().count() == 2
    v = spark.createDataFrame([("t", 10, 1, 0, "A", "C"), ("t", 10, 1, 1, "A", "G"), ("t", 20, 3, 0, "ACG", "A"), ("t", 21, 1, 1, "C", "T")], "t_name string, ts int, tl int, hap int, t_str string, q_str string")
    cover = spark.createDataFrame([("t", 0, 0, 100), ("t", 1, 0, 15)], "t_name string, hap int, b_bgn int, b_end int")
    assert rows(X.genotypes(v, cover)) == [("t", 11, "A", "C,G", "1|2"), ("t", 21, "ACG", "A,ATG", "1|.")]


def _write_sequences(spark, where, seqs: list[str]) -> str:
    form = "sid int, name string, source string, seq string"
    spark.createDataFrame([(k, f"n{k}", "s", s) for k, s in enumerate(seqs)] * 2, form).write.parquet(f"{where}/sequences.parquet")
    return str(where)


ODD = ["", "ACG", None, "acgtNNNNacgtacgtACGTNacgt" * 3, "N" * 90, "ACGTRYKM" * 9, bases(300, 4), bases(300, 4)[50:] + "N" + bases(99, 6), back(bases(300, 4)), "ACGTÄ" + bases(80, 5) + "ß" + bases(80, 5), bases(11, 9), bases(12, 9)]


def test_kmer_counts_of_odd_and_of_many_sequences(spark, tmp_path):
    from collections import Counter

    from strandframe.plans.relational import kmer_count

    upper = [s and spark.createDataFrame([(s,)], "s string").select(F.upper("s")).first()[0] for s in ODD]
    slow = Counter(s[i : i + 12] for s in upper if s for i in range(len(s) - 11))
    assert rows(kmer_count(spark, _write_sequences(spark, tmp_path / "odd", ODD)), "kmer", "n") == sorted(slow.items())
    many = _write_sequences(spark, tmp_path / "many", [bases(3000, k) for k in range(2000)])
    began = time.monotonic()
    assert kmer_count(spark, many).agg(F.sum("n")).first()[0] == 2000 * 2989
    assert time.monotonic() - began < 25  # the whole test takes 16 s, and took 54 s with a string for each k-mer


def test_multi_filter_of_odd_and_of_many_sequences(spark, tmp_path):
    from strandframe.plans.relational import multi_filter

    # ids divisible by 50 are references: every odd sequence is one once, and once a read
    seqs = [None] * (50 * len(ODD))
    for k, s in enumerate(ODD):
        seqs[50 * k], seqs[50 * k + 1] = s, s
    upper = [s and spark.createDataFrame([(s,)], "s string").select(F.upper("s")).first()[0] for s in seqs[: 50 * len(ODD) : 50]]
    mers = [{s[i : i + 31] for i in range(len(s) - 30)} if s else set() for s in upper]
    both = [m | {back(x) for x in m} for m in mers]
    slow = [(50 * a, 50 * b + r, len(both[a] & mers[b])) for a in range(len(ODD)) for b in range(len(ODD)) for r in (0, 1) if len(both[a] & mers[b]) >= 4]
    assert rows(multi_filter(spark, _write_sequences(spark, tmp_path / "odd", seqs)), "ref_sid", "sid", "n") == sorted(slow)
    many = _write_sequences(spark, tmp_path / "many", [bases(3000, k) for k in range(2000)])
    began = time.monotonic()
    assert multi_filter(spark, many).count() == 40  # each reference with itself
    assert time.monotonic() - began < 25  # the whole test takes 8 s; this part took 49 s with a string for each k-mer


def test_alignments_of_many_pairs_are_those_of_each():
    rnd = random.Random(1)

    def changed(s: str, rate: float) -> str:
        return "".join("" if rnd.random() < rate else rnd.choice("ACGT") if rnd.random() < rate else c + rnd.choice("ACGT") * (rnd.random() < rate) for c in s)

    pairs = [(t, changed(t, rate)) for n in (0, 1, 2, 3, 5, 8, 13, 30, 60) for k in range(20) for t in ["".join(rnd.choice("AC" if k % 2 else "ACGT") for _ in range(n))] for rate in (0, 0.02, 0.2)]
    pairs += [("", "ACG"), ("ACG", ""), ("", "")]
    for left, one in ((True, A.align_left), (False, A.affine_align)):
        for most in (None, 5, 384):
            assert A.affine_many(pairs, most=most, left=left) == [one(t, q, most=most) for t, q in pairs]


def test_records_align_each_segment_once(spark):
    many = [(t, t[:90] + "A" + t[90:]) for t in (bases(180, k) for k in range(2000))]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(many)], "k int, t_seq string, q_seq string").repartition(1)
    began = time.monotonic()
    assert A.aligned(df).agg(F.max("cost")).first()[0] == 4
    took = time.monotonic() - began
    assert took < 5, took


def test_hits_of_a_repeat_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARE", 1000, raising=False)
    form = "h0 long, h1 long, sid int, bgn int, end_pos int, orientation int"
    index = [(1, 1, k, k, k + 5, 0) for k in range(300)] + [(2, 2, 0, 7, 9, 1)] + [(3, 3, 1, k, k, 0) for k in range(3)]
    asked = [(1, 1, k, 0, 1, 0) for k in range(90)] + [(2, 2, k, 0, 1, 0) for k in range(3000)] + [(3, 3, 5, 0, 1, 0), (4, 4, 6, 0, 1, 1)]
    got = P.hits(spark.createDataFrame(asked, form), spark.createDataFrame(index, form))
    want = [(*q[:3], *(x[2:4] if x else (None, None))) for q in asked for x in [i for i in index if i[:2] == q[:2]] or [None]]
    key = lambda r: [(x is not None, x or 0) for x in r]
    assert rows(got, "h0", "h1", "q_sid", "sid", "bgn") == sorted(want, key=key)
    # the 27,000 hits of the first pair came from one partition
    assert got.where("h0 = 1").select(F.spark_partition_id().alias("p")).distinct().count() > 1
