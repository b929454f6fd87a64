"""Operators for training data against slow versions, with dirty input."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandframe.llm import heavy_hitters as L, leakage as K, mixing as M, residue as R, shared_spans as S, splitting as X


def rows(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: [(x is not None, str(type(x)), x) for x in r])


# ------------------------------------------------------------------ 1 shared spans


def shared_by_hand(data, n):
    where = defaultdict(set)
    good = [(sid, s.upper()) for sid, s in data if sid is not None and s]
    for sid, s in good:
        for i in range(len(s) - n + 1):
            where[s[i : i + n]].add(sid)
    out = set()
    for sid, s in good:
        covered = np.zeros(len(s) + 1, bool)
        for i in range(len(s) - n + 1):
            w = s[i : i + n]
            if len(where[w]) > 1 and not set(w) - set("ACGT"):
                covered[i : i + n] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], covered)).astype(int)))
        out |= {(sid, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])}
    return sorted(out)


def every_minimizer(records, length, k, spread):
    return [r.m for r in S._pieces(records, length, k).select("m").distinct().collect()], 1.0


@pytest.mark.parametrize("weights", [S._weights, every_minimizer])
def test_shared_spans(spark, monkeypatch, weights):
    monkeypatch.setattr(S, "_weights", weights)
    rnd = random.Random(7)
    base = "".join(rnd.choice("ACGT") for _ in range(900))
    dull = "A" * 700
    data = [(1, base), (2, base[:300].lower() + "NN" + base[300:]), (3, base[100:180] + dull), (4, dull + base[500:]), (5, "".join(rnd.choice("ACGT") for _ in range(400)) + "AC" * 200), (6, "AC" * 150), (7, None), (8, ""), (9, "ACGT"), (None, base), (1, base)]
    df = spark.createDataFrame([(i, s, 1, "x") for i, s in data], "sid int, seq string, m int, id string")
    assert rows(S.shared_spans(df, "sid", "seq", length=40, k=12)) == shared_by_hand(data, 40)
    assert rows(S.shared_spans(df, "sid", "seq", length=40, k=12, spread=20)) == shared_by_hand(data, 40)
    if weights is not every_minimizer:
        assert S.shared_spans(df.where("false"), "sid", "seq", length=40, k=12).count() == 0
        assert rows(S.shared_sizes(spark.createDataFrame([(1, 0, 5), (1, 9, 10)], "sid int, bgn long, end_pos long"), "sid")) == [(1, 2, 6)]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_minimizers_are_counted_some_at_a_time(monkeypatch, size):
    monkeypatch.setattr(S, "AT_ONCE", 60)
    rnd = random.Random(size)
    base = "".join(rnd.choice("ACGT") for _ in range(600))
    data = [(1, base), (2, base[50:200] + "T" + base[201:500]), (3, base[300:]), (4, "A" * 300), (5, "C" + "A" * 200), (6, "".join(rnd.choice("ACGT") for _ in range(300))), (7, base[:90] + "G" + base[91:140])]
    owner, first, windows, m, blob = S.cut_pieces([t.encode() for _, t in data], 40, 12)
    order = np.argsort(m, kind="stable")
    batch = pa.RecordBatch.from_arrays([pa.array([f"r{data[o][0]}" for o in owner[order]]), pa.array(first[order]), pa.array(windows[order].astype(np.int32)), pa.array(m[order]), blob.take(pa.array(order))], ["id", "first", "windows", "m", "piece"])
    out = S._count_together(40)(batch.slice(i, size) for i in range(0, batch.num_rows, size))
    covered = defaultdict(lambda: np.zeros(601, bool))
    for b in out:
        for i, bgn, end in zip(*(c.to_pylist() for c in b.columns)):
            covered[int(i[1:])][bgn:end] = True
    found = []
    for i, c in covered.items():
        edge = np.flatnonzero(np.diff(np.concatenate(([False], c)).astype(int)))
        found += [(i, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    assert sorted(found) == shared_by_hand(data, 40)


def test_long_records_are_worked_off_in_chunks(monkeypatch, spark):
    monkeypatch.setattr(S, "CHUNK", 64)
    rnd = random.Random(8)
    base = "".join(rnd.choice("ACGT") for _ in range(500))
    texts = [base.encode(), base[37:300].encode()]
    got = S.cut_pieces(texts, 40, 12)
    owner, first, windows, _, _ = got
    for i, t in enumerate(texts):
        covered = sorted(x for o, f, w in zip(owner, first, windows) if o == i for x in range(f, f + w))
        assert covered == list(range(len(t) - 40 + 1))


def test_equal_windows_have_equal_hashes_wherever_they_lie():
    rnd = random.Random(9)
    piece = "".join(rnd.choice("ACGT") for _ in range(60))
    owner, first, windows, _, blob = S.cut_pieces([b"TTT" + piece.encode() + b"G", piece.encode() + b"CC"], 40, 12)
    h = S.window_hashes(blob.to_pylist(), windows.astype(np.int64), 40)
    seen = defaultdict(list)
    at = 0
    for o, f, w in zip(owner, first, windows):
        for x in range(w):
            text = (("TTT" + piece + "G") if o == 0 else (piece + "CC"))[f + x : f + x + 40]
            seen[text].append(int(h[at + x]))
        at += w
    assert all(len(set(v)) == 1 for v in seen.values()) and len({v[0] for v in seen.values()}) == len(seen)


# ------------------------------------------------------------------ 2 splitting


def slow_split(size, ends, limit, overlap):
    out, bgn, last = [], 0, 0
    while size - bgn > limit:
        near = [e for e in ends if last < e <= bgn + limit]
        end = max(near) if near else bgn + limit
        out.append((bgn, end))
        last, bgn = end, end - overlap
    return [*out, (bgn, size)]


@given(st.lists(st.integers(0, 60), max_size=30), st.integers(20, 50), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_cuts(lengths, limit, overlap):
    size, ends = sum(lengths), np.cumsum(lengths).tolist()
    for strategy in X.STRATEGIES:
        cutter = X.STRATEGIES[strategy](size, limit, overlap)
        for e, n in zip(ends, lengths):
            if n:
                cutter.boundary(e, n)
        got = cutter.close()
        assert got[0][0] == 0 and got[-1][1] == size and all(b <= e and e - b <= limit for b, e in got)
        assert all(q[0] == p[1] - overlap or strategy == "bisect" and q[0] == max(0, p[1] - overlap) for p, q in zip(got, got[1:]))
        if strategy == "furthest" and size > limit:
            assert got == slow_split(size, ends, limit, overlap)


def test_split_oversized(spark):
    items = [(7, 90, 30, 70), (1, 100, 0, 4), (1, 100, 0, 4), (2, 100, None, None), (3, 100, 0, 5), (4, 10, 0, 4), (None, 100, 0, 1), (5, None, 0, 1), (6, 90, 20, 2)]
    parts = [(0, 30), (1, 25), (2, 0), (3, 45), (3, 45), (20, 20), (21, None), (None, 4), *((i, 1) for i in range(30, 65)), *((i, 9) for i in range(66, 99))]
    di = spark.createDataFrame([(*x, "z") for x in items], "id long, size long, part_start int, part_n int, length string")
    dp = spark.createDataFrame([(*x, 0) for x in parts], "part_id long, length int, id int")
    want = sorted([(1, *p) for p in slow_split(100, [30, 55, 100], 40, 5)] + [(2, *p) for p in slow_split(100, [], 40, 5)] + [(3, *p) for p in slow_split(100, [30, 55, 100], 40, 5)] + [(6, *p) for p in slow_split(90, [20], 40, 5)] + [(7, *p) for p in slow_split(90, list(range(1, 36)), 40, 5)])
    assert rows(X.split_oversized(di, dp, 40, 5)) == want
    assert X.split_oversized(di.where("false"), dp, 40, 5).count() == 0
    with pytest.raises(ValueError):
        X.split_oversized(di, dp, 5, 5)


# ------------------------------------------------------------------ 6 frequent items


@given(st.lists(st.integers(0, 30), max_size=400), st.integers(2, 20), st.integers(1, 50))
@settings(max_examples=100, deadline=None)
def test_lossy_counter_keeps_its_bounds(values, width, block):
    c = L.LossyCounter(width)
    for i in range(0, len(values), block):
        c.add(np.array(values[i : i + block], np.int64))
    true, kept = Counter(values), {}
    for v, low, under in zip(c.val.tolist(), c.low.tolist(), c.under.tolist()):
        assert low <= true[v] <= low + under
        kept[v] = low
    assert all(n <= c.bucket for v, n in true.items() if v not in kept)


def test_frequent_items_over_partitions(spark):
    rnd = random.Random(2)
    data = [(7 if rnd.random() < 0.3 else rnd.randrange(5000), None if rnd.random() < 0.1 else 3, "c0") for _ in range(20_000)]
    df = spark.createDataFrame(data, "a long, b long, val string").repartition(6)
    found = {(r.slot, r.val): r for r in L.frequent_items(df, ["a", "b"], width=200, block=512).collect()}
    for slot, column in enumerate(zip(*[d[:2] for d in data])):
        true = Counter(v for v in column if v is not None)
        total = sum(true.values())
        for v, n in true.items():
            r = found.get((slot, v))
            assert n <= total / 200 if r is None else r.low <= n <= r.high and r.high - r.low <= total / 200 and r.total == total
    assert rows(L.above_share(L.frequent_items(df, ["a"], width=200), 0.2), "val") == [(7,)]
    assert L.frequent_items(df.where("false"), ["a"]).count() == 0


# ------------------------------------------------------------------ 8 leakage


def test_words():
    assert K.words("A<b>c</b>d Co­op​er x<y; ＡＢ é_1") == ["a", "c", "d", "cooper", "x", "y", "ab", "é", "1"]
    assert K.words(None) == [] and K.words("<!-- no --> 5 < 6 > 4") == ["5", "6", "4"]


def test_leaked_items(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rnd.choice([3, 8, 12, 30, 60])))) for i in range(25)] + [(50, None), (51, "")]
    docs = []
    for d in range(80):
        body = text(80)
        if d % 2:
            src = K.words(items[d % 25][1])
            n = min(len(src), rnd.choice([11, 12, 20]))
            at = rnd.randrange(len(src) - n + 1)
            body[40:40] = src[at : at + n]
        docs.append((d, ", ".join(body), 0))
    docs += [(100, None, 0), (101, "", 0), (102, "w1 " * 30_000, 0), (0, docs[0][1], 0)]
    dd, di = spark.createDataFrame(docs, "doc_id long, text string, item int"), spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, doc string")
    found = {(r.doc_id, r.item_id): r for r in K.leaked_items(dd, "doc_id", "text", di, "item_id", "text").collect()}
    got = {k for k, r in found.items() if r.run >= min(12, len(K.words(dict(items)[k[1]])))}
    want = set()
    for d, t, _ in docs:
        w = K.words(t)
        for i, s in items:
            p = K.words(s)
            n = min(12, len(p))
            if n and {tuple(w[x : x + n]) for x in range(len(w) - n + 1)} & {tuple(p[x : x + n]) for x in range(len(p) - n + 1)}:
                want.add((d, i))
    assert got == want and want
    assert all(r.score >= 2 * min(r.run, 5) for r in found.values())


def test_edited_copies_score_high_and_blocks_agree(spark, monkeypatch):
    item = [f"q{i}" for i in range(40)]
    edited = [("z" if i % 9 == 4 else w) for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 20 + edited + ["y"] * 20)), (2, " ".join(f"n{i}" for i in range(50)))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item)), (6, "n7 n8 n9"), (7, "n1 nope n3")], "item_id long, text string")
    one = rows(K.leaked_items(docs, "doc_id", "text", items, "item_id", "text"))
    assert [(r[0], r[1]) for r in one] == [(1, 5), (2, 6)] and one[0][4] > 0.6 and one[1][4] == 1.0
    monkeypatch.setattr(K, "BLOCK_WORDS", 20)
    assert rows(K.leaked_items(docs, "doc_id", "text", items, "item_id", "text")) == one


def test_edited_copy_beside_an_exact_one(spark):
    item = [f"q{i}" for i in range(40)]
    edited = [("z" if i % 9 == 4 else w) for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 20 + edited + ["y"] * 20)), (2, " ".join(item)), (3, " ".join(item[:6] + ["n"] * 40))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    found = K.leaked_items(docs, "doc_id", "text", items, "item_id", "text", least=0.5, rare=False)
    assert [(r[0], r[2]) for r in rows(found, "doc_id", "item_id", "run")] == [(1, 8), (2, 40)]
    every = rows(K.leaked_items(docs, "doc_id", "text", items, "item_id", "text", rare=False))
    assert [r for r in every if r[4] >= 0.5] == rows(found) and len(every) == 3


def slow_alignment(a, b):
    score, run, best, longest = defaultdict(int), defaultdict(int), 0, 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            same = x == y and x > 0
            run[i, j] = run[i - 1, j - 1] + 1 if same else 0
            score[i, j] = max(0, score[i - 1, j - 1] + (2 if same else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
            best, longest = max(best, score[i, j]), max(longest, run[i, j])
    return best, longest


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), min_size=1, max_size=14))
@settings(max_examples=200, deadline=None)
def test_smith_waterman(a, b):
    assert K.smith_waterman(np.array(a, np.int32), np.array(b, np.int32)) == slow_alignment(a, b)


# ------------------------------------------------------------------ 9 mixing


def test_raking_meets_the_sources_and_the_caps():
    cells = [("a", "en", "x", 100.0), ("a", "de", "y", 50.0), ("b", "en", "x", 30.0), ("b", "de", "x", 10.0)]
    w = M.rake(cells, {"a": 0.5, "b": 0.5}, {"a": 1.0, "b": 3.0}, 200.0)
    for s, cap in (("a", 1.0), ("b", 3.0)):
        own = [(x, c) for x, c in zip(w, cells) if c[0] == s]
        assert sum(x * c[3] for x, c in own) == pytest.approx(100.0) and all(0 <= x <= cap + 1e-9 for x, _ in own)


@given(st.lists(st.tuples(st.floats(0.01, 5), st.integers(1, 50)), min_size=1, max_size=30), st.floats(0.5, 3), st.floats(0.05, 1))
@settings(max_examples=200, deadline=None)
def test_filling_reaches_the_goal_under_the_cap(items, top, part):
    cells = [("a", "l", "t", float(n)) for _, n in items]
    w = [x for x, _ in items]
    goal = part * top * sum(c[3] for c in cells)
    M._fill(w, list(range(len(w))), cells, goal, top)
    assert sum(x * c[3] for x, c in zip(w, cells)) == pytest.approx(goal) and all(0 <= x <= top * (1 + 1e-9) for x in w)
    # the order of the weights stays, so those at the cap are the largest
    before = [x for x, _ in items]
    assert all(w[i] <= w[j] + 1e-9 for i in range(len(w)) for j in range(len(w)) if before[i] <= before[j])


@pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no vocabulary file here")
def test_mix(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join("word" * rnd.randrange(1, 3) for _ in range(rnd.randrange(5, 60))), rnd.choice(["a", "A ", "a", "b", "c", None]), rnd.choice(["en", "de", None]), "t1,t2", 9) for i in range(600)]
    docs += [(1000, None, "a", "en", None, 9), (1001, "", "b", "en", "t", 9), docs[0]]
    dd = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, tags string, tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 4), (" C", 2.0, None), ("none", 3.0, 2), (None, 1.0, 1), ("d", 0.0, 1)], "source string, weight double, max_repeats int")
    mix, report, margins = M.mix_sources(dd, targets, "doc_id", "text", "source", F.col("lang"), F.split("tags", ",")[0])
    by = {r.source: r for r in report.collect()}
    assert set(by) == {"a", "b", "c", "none"} and by["none"].reached_share == 0 and by["none"].docs == 0
    for s, share in (("a", 0.25), ("b", 0.25), ("c", 0.5)):
        assert abs(by[s].reached_share - share) < 0.01 and by[s].share_of_present == share
    assert by["a"].most_copies <= 1 and by["b"].most_copies <= 4
    assert rows(mix) == rows(M.mix_sources(dd, targets, "doc_id", "text", "source", F.col("lang"), F.split("tags", ",")[0])[0])
    none, empty, bare = M.mix_sources(dd.where("false"), targets, "doc_id", "text", "source", F.col("lang"), F.lit(None).cast("string"))
    assert none.count() == 0 and {r.tokens for r in empty.collect()} == {0} and bare.count() == 0
    held = {(r.margin, r.value): (r.wanted_share, r.reached_share) for r in margins.collect()}
    assert {v for m, v in held if m == "source"} == {"a", "b", "c"} and all(abs(w - g) < 0.02 for w, g in held.values())
    for m in ("source", "language", "topic"):
        assert sum(w for (k, _), (w, _) in held.items() if k == m) == pytest.approx(1) and sum(g for (k, _), (_, g) in held.items() if k == m) == pytest.approx(1)


@pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no vocabulary file here")
def test_token_counts_of_very_long_texts(spark):
    import base64

    import tiktoken

    with open(M.TOKENIZER, "rb") as f:
        own = tiktoken.Encoding("own", pat_str=M.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    texts = ["", "Hello  world's 12 <|endoftext|>\n\n x", "ab cd  ef, " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert rows(M.count_tokens(df, "text", ["i"])) == [(i, len(own.encode_ordinary(t))) for i, t in enumerate(texts)]


# ------------------------------------------------------------------ 10 residue

#: Wordings that were not looked at when the rules were written.
NOTICES = [
    "We're sorry but this app doesn't work properly without JavaScript enabled.", "Please enable cookies in your browser settings.", "Your browser does not support JavaScript!", "Diese Seite benötigt JavaScript.", "Este sitio requiere JavaScript para funcionar",
    "502 Bad Gateway", "Sorry, the page at /forum/view.php could not be found.", "Uncaught exception on 2024-05-01 12:30:11", "Service temporarily unavailable", "Zugriff verweigert", "This content has been removed.", "Oops, something went wrong!", "Die Seite ist derzeit nicht erreichbar.",
    "Your answer goes here", "TBD", "This is a sample post.", "Texte de remplissage.", "Dear {{customer.name}}, thank you for your order {{order}}!", "Hello [insert name here],", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "asdf asdf blah qwer asdf",
]
REAL = [
    "Solved, thanks!", "Use the index instead.", "Home | Questions | Tags", "See the other thread", "I get an internal server error when my script runs.", "My browser blocks cookies, can anyone tell why?",
    "The index is built from the sorted list of marks, so it stays small.", "> 404 Not Found\n> Please enable JavaScript", "```\nlorem ipsum dolor\n```",
]


def posts(texts, first=0, copies=12):
    return [(first + 100 * i + j, f"About w{first + i} and v{j * 7}\n\n{t}\n\n(c) the board", f" S{j % 4} " if j % 2 else f"s{j % 4}") for i, t in enumerate(texts) for j in range(copies)]


def residue_of(spark, data, **how):
    df = spark.createDataFrame([(*d, 1, 2) for d in data], "doc_id long, text string, source string, words int, h int")
    return sorted({r.doc_id for r in R.find_residue(df, "doc_id", "text", "source", **how).collect()})


def test_recurring_notices_of_unseen_wording(spark):
    bad, good = posts(NOTICES), posts(REAL, 10_000)
    mixed = [(20_000, NOTICES[5] + "\n\n" + " ".join(f"Then w{i} came out of the {i}th box." for i in range(40)), "s1"), (20_001, None, "s1"), (20_002, "", "s2"), (20_003, "w " * 100_000, None)]
    assert residue_of(spark, bad + good + mixed + bad[:3]) == [d[0] for d in bad]
    assert residue_of(spark, []) == []


def test_only_what_recurs_over_documents_and_sources_is_classified(spark):
    few = posts(NOTICES[5:6], 0, 7)
    assert residue_of(spark, few) == [] and residue_of(spark, few, min_docs=7) == [d[0] for d in few]
    assert residue_of(spark, [(i, t, "one") for i, t, _ in posts(NOTICES[5:6])]) == []
    # copies within a document and repeated rows of a document count once
    assert residue_of(spark, [(i, f"{t}\n{NOTICES[5]}\n{NOTICES[5]}", s) for i, t, s in few]) == [] and residue_of(spark, few * 3) == []


def test_filler_words_are_learned_from_their_company(spark):
    rnd = random.Random(6)
    words = "lorem ipsum tarvo quint melda sorin pexa vollo umbri".split()
    filler = [(i, ". ".join(" ".join(rnd.choice(words) for _ in range(6)) for _ in range(4)), f"s{i % 4}") for i in range(60)]
    text = [(1000 + i, " ".join(f"{rnd.choice(['the', 'a'])} {rnd.choice(['map', 'list', 'gap'])} {rnd.randrange(9)}x holds w{rnd.randrange(50)}" for _ in range(9)), f"s{i % 4}") for i in range(60)]
    assert residue_of(spark, filler + text) == [d[0] for d in filler]
