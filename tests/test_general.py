"""Hierarchies, packed values and rejects against slow versions, with dirty input."""

from __future__ import annotations

import random
import re

from helpers import rows
import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from strandframe.operators import hierarchy as H, packed as P, rejects as R
from strandframe.plans import general as G


def slow_hierarchy(nodes, links):
    nodes = {n for n in nodes if n is not None}
    up = {n: {p for c, p in links if c == n and p in nodes} for n in nodes}
    waiting, out = {n: len(p) for n, p in up.items()}, {}
    ready = [n for n in nodes if not waiting[n]]
    for n in ready:
        out[n] = (n, 0)
    while ready:
        n = ready.pop()
        for c in nodes:
            if n in up[c]:
                waiting[c] -= 1
                first = min(up[c])
                if not waiting[c]:
                    out[c] = (out[first][0], out[first][1] + 1)
                    ready.append(c)
    return sorted((n, *out.get(n, (-1, -1))) for n in nodes)


def run(spark, nodes, links):
    n = spark.createDataFrame([(x, "extra") for x in nodes], "node long, root string")
    e = spark.createDataFrame([(*x, 5) for x in links], "child long, parent long, node int")
    return H.hierarchy(n, e)


@pytest.mark.parametrize("seed", range(3))
def test_random_links_with_many_parents(spark, seed):
    rnd = random.Random(seed)
    nodes = list(range(60))
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(50)] + [(c, rnd.randrange(c)) for c in range(1, 60) if rnd.random() < 0.3]
    assert rows(run(spark, nodes, links), "node", "root", "depth") == slow_hierarchy(nodes, links)


def test_paths_over_many_parts(spark):
    rnd = random.Random(3)
    links = [(c, rnd.randrange(max(0, c - 9), c)) for c in range(1, 300)] + [(c, rnd.choice([400, *range(400, c)][-30:])) for c in range(401, 500)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.node: r.path for r in H.paths(run(spark, [*range(300), *range(400, 500)], links)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    up = dict(links)
    for n, path in got.items():
        want = [n]
        while want[0] in up:
            want.insert(0, up[want[0]])
        assert path == want
    assert len(got) == 400


def test_hierarchies_with_cycles_second_parents_and_dirt(spark):
    rnd = random.Random(5)
    nodes = list(range(0, 160, 2))
    single = [(c, rnd.choice(nodes[:i])) for i, c in enumerate(nodes) if i and rnd.random() < 0.9]
    a, b, c = 100, 102, 104
    links = [x for x in single if x[0] not in (a, b, c)] + [(a, b), (b, c), (c, a), (4, 999), (None, 2), (6, None), (8, 8)]
    # cycles through second parents only, and a node below a root and below a cycle
    links += [(201, 200), (201, 203), (203, 200), (203, 201), (205, 200), (205, 100), (207, 205)]
    nodes += [200, 201, 203, 205, 207]
    got = run(spark, [*nodes, nodes[0], None], [*links, links[0]])
    assert rows(got, "node", "root", "depth") == slow_hierarchy(nodes, links)


def test_a_long_chain_a_wide_parent_and_paths(spark):
    chain = [(i, i - 1) for i in range(1, 70)]
    wide = [(i, 1000) for i in range(1001, 1400)]
    laid = H.cut(run(spark, [*range(70), *range(1000, 1400)], chain + wide))
    assert rows(laid, "node", "root", "depth")[:70] == [(i, 0, i) for i in range(70)]
    assert rows(laid.where("node > 1000"), "root", "depth") == [(1000, 1)] * 399
    path = {r.node: r.path for r in H.paths(laid).collect()}
    assert path[69] == list(range(70)) and path[1003] == [1000, 1003]
    below = H.descendants(laid).where("ancestor = 1000 OR ancestor = 67")
    assert rows(below.where("ancestor = 67"), "node", "distance") == [(68, 1), (69, 2)] and below.count() == 401


def test_empty_hierarchy(spark):
    laid = H.cut(run(spark, [], []))
    assert laid.count() == 0 and H.paths(laid).count() == 0


def slow_segments(text):
    parts, cell, inside = [], "", False
    for ch in text:
        inside ^= ch == '"'
        if not inside and ch in ";,|":
            parts.append((cell, ch))
            cell = ""
        else:
            cell += ch
    out, tag, seen, first = [], None, {}, True
    for cell, end in [*parts, (cell, ";")]:
        if first and (m := re.match(r'^ *([^"=]*?) *=(.*)$', cell, re.S) or re.match(r'^ *([^"=]*[^"= ]) +(".*)$', cell, re.S)):
            tag, cell = m[1] or tag, m[2]
        v = cell.strip(" ")
        if len(v) > 1 and v[0] == v[-1] == '"':
            v = v[1:-1].replace('""', '"')
        if v:
            seen[tag] = seen.get(tag, 0) + 1
            out.append((tag, seen[tag], v))
        first = end == ";"
    return out


value = st.one_of(st.from_regex(r"[a-c:]{0,4}", fullmatch=True), st.from_regex(r"[a-c ;,|=]{0,6}", fullmatch=True).map(lambda v: f'"{v}"'), st.just('"x ""y"" z"'))


@given(st.lists(st.tuples(st.sampled_from(["ID=", "T = ", "", "N "]), st.lists(value, max_size=4), st.sampled_from([",", "|", " , "])), max_size=5), st.booleans())
@settings(max_examples=200, deadline=None)
def test_segments_match_a_letter_by_letter_scan(fields, known):
    text = ";".join((t if t != "N " or (v and v[0][:1] == '"') else "N=") + sep.join(v) for t, v, sep in fields)
    marks = P.automaton(["a;b", "x ,y", "a"] if known else [], False)
    assert P.segment(text, marks) == slow_segments(text) == P.segment(text, marks, False) == P.quoted_segment(text)


@given(st.text("ab =;,|", max_size=20), st.text('ab =;,|"', max_size=20))
@settings(max_examples=500, deadline=None)
def test_texts_without_a_dictionary_are_split_by_quotes_alone(plain, text):
    assert P.segment(plain, P.automaton(["a;b"], False), False) == P.segment(plain, P.automaton([], False)) == P.quoted_segment(plain)
    assert P.quoted_segment(text) == P.segment(text, P.automaton([], False))


def test_held_out_values_without_their_quotes(spark):
    """The dictionary decides: quotes are taken off in half of the records, and their values come back by what the other half taught."""
    rnd = random.Random(12)
    values = [f"{a}{rnd.choice([', ', ';', '|'])}{b} {rnd.randrange(100)}" for a in ("alpha", "beta", "gamma") for b in ("form", "group", "band") for _ in range(20)]
    records = [(i, [rnd.choice(values) if rnd.random() < 0.7 else f"plain{rnd.randrange(9)}" for _ in range(3)]) for i in range(2000)]
    mark = lambda v, bare: v if bare or v.startswith("plain") else f'"{v}"'
    df = spark.createDataFrame([(i, "Note=" + ",".join(mark(v, i % 2) for v in vs)) for i, vs in records], "rec_id long, attributes string")
    known = P.learned_values(df, "attributes")
    got = rows(P.split_packed(df, "rec_id", "attributes", known, protect=True), "rec_id", "pos", "val")
    assert got == [(i, p + 1, v) for i, vs in records for p, v in enumerate(vs)]
    without = rows(P.split_packed(df, "rec_id", "attributes", [], protect=True), "rec_id", "pos", "val")
    assert len(without) > len(got) and [r for r in without if r[0] % 2 == 0] == [r for r in got if r[0] % 2 == 0]


def test_dictionary_protects_unquoted_values():
    marks = P.automaton(["alpha, beta form"], True)
    assert P.segment("Note=alpha, beta form,gamma;ID=1", marks) == [("Note", 1, "alpha, beta form"), ("Note", 2, "gamma"), ("ID", 1, "1")]
    assert P.segment("Note=xalpha, beta form", marks) == [("Note", 1, "xalpha"), ("Note", 2, "beta form")]


blank_value = st.from_regex(r'[a-b ;,|="]{2,7}', fullmatch=True)


@given(st.lists(st.one_of(blank_value, st.sampled_from(["=", ";", " , ", '"a;b"', "|", "a;b", "a ,b", '"x""a;b"'])), max_size=8), st.lists(blank_value, max_size=4))
@settings(max_examples=300, deadline=None)
def test_candidates_hold_every_known_value_that_counts(pieces, known):
    text, known = "".join(pieces), [v for v in ["a;b", "a ,b", *known, *pieces] if any(c in v for c in ";,|")]
    found = P.candidates(text, max(map(len, known)))
    assert P.segment(text, P.automaton([v for v in known if v in found], True)) == P.segment(text, P.automaton(known, True))


def test_every_quoted_value_is_protected_elsewhere(spark):
    n = 10_500  # more than a dictionary of stated size holds
    quoted = spark.range(n).selectExpr("id AS rec_id", """concat('N="v', id, ',w', id, '"') AS attributes""")
    bare = spark.range(n).selectExpr(f"id + {n} AS rec_id", "concat('N=v', id, ',w', id, ' ; K=v', id, ',w') AS attributes")
    df = quoted.unionByName(bare)
    got = P.split_packed(df, "rec_id", "attributes", P.learned_values(df, "attributes"), protect=True)
    assert got.where("tag = 'N' AND pos = 1 AND val = concat('v', rec_id % 10500, ',w', rec_id % 10500)").count() == 2 * n
    assert got.count() == 2 * n + 2 * n and got.where("tag = 'K'").count() == 2 * n


def test_split_packed_with_dirty_rows(spark):
    data = [(1, 'ID=a;Note="x;y",z', 9), (1, 'ID=a;Note="x;y",z', 8), (2, None, 1), (3, "", 1), (4, "no tag", 1), (5, 'A="open', 1), (6, "K=" + ",".join("v" * 3 for _ in range(20_000)), 1), (None, "A=1", 1)]
    df = spark.createDataFrame(data, "rec_id long, attributes string, val int")
    got = P.split_packed(df, "rec_id", "attributes", P.learn_dictionary(df, "attributes"))
    assert rows(got.where("rec_id < 6")) == [(1, "ID", 1, "a"), (1, "Note", 1, "x;y"), (1, "Note", 2, "z"), (4, None, 1, "no tag"), (5, "A", 1, '"open')]
    assert got.where("rec_id = 6").count() == 20_000 and got.where("rec_id IS NULL").count() == 1
    assert P.split_packed(df.where("false"), "rec_id", "attributes").count() == 0


def test_p4_found_learns_nothing_and_is_what_its_sql_gives(spark, tmp_path, monkeypatch):
    def write(name, *texts):
        spark.createDataFrame(list(enumerate(texts)), "rec_id long, attributes string").write.parquet(f"{tmp_path / name}/gff_records.parquet")
        return str(tmp_path / name)

    def of_sql(base):
        with duckdb.connect() as db:
            db.execute(f"CREATE VIEW gff_records AS FROM read_parquet('{base}/gff_records.parquet/*.parquet')")
            return sorted(db.execute(G.ORACLES["p4_found"]).fetchall())

    base = write("odd", 'N="a;b","c ""d"" | e"', "N=a;b,c", 'x;N "a;b" , "a;b"', 'N="a;b', 'N=x"a;b";"a;b"', ' = "a|b";=c;;N=,|;', None, "", '"a;b"=c;ID=1,2;ID=3')
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "collect", lambda _: pytest.fail("rows were collected before the query ran"))
        got = G.p4_found(spark, base)
    assert rows(got) == of_sql(base) and got.count() == 14
    # learning the quoted values ended the JVM at 5,000 letters
    base = write("long", 'N="a;' + "x" * 200_000 + '",y')
    assert rows(G.p4_found(spark, base)) == of_sql(base) == [(0, "N", 1, "a;" + "x" * 200_000), (0, "N", 2, "y")]


GOOD = "c\ts\tgene\t1\t5\t.\t+\t0\tID=1"


def test_rejects(spark):
    lines = [
        (1, GOOD, None), (2, GOOD + "\r", None), (3, "# c", None), (4, "", None), (5, None, None), (6, "a\tb", "columns"), (7, GOOD + "\t\t", "columns"), (8, GOOD.replace("ID=1", 'N="a"b'), "quoting"),
        (9, GOOD.replace("ID=1", 'N="a ""b"" c" , "d" ; X "e"'), None), (10, GOOD.replace("\t1\t", "\t0\t"), "value"), (11, GOOD.replace("\t5\t", "\t4294967296\t"), "value"), (12, GOOD.replace("\t.\t", "\tinf\t"), "value"),
        (13, GOOD.replace("\t.\t", "\t-1.5e-3\t"), None), (14, GOOD.replace("\t0\t", "\t3\t"), "value"), (15, GOOD.replace("ID=1", "N=" + "x" * 3_000_000), None), (16, GOOD.replace("\t1\t", "\t٣\t"), "value"), (17, " ", "columns"), (18, GOOD.replace("ID=1", "a\nb"), None),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in lines] + [(6, "a\tb", "y")], "line_id long, line string, reason string")
    got = R.load_with_rejects(df, "line_id", "line")
    assert rows(got, "line_id", "reason") == [(i, r) for i, t, r in lines if t and not t.startswith("#")]
    assert {r.attributes for r in got.where("line_id = 18").collect()} == {"a\nb"}
    assert rows(R.load_with_rejects(df, "line_id", "line", "rejected"), "line_id") == [(i,) for i, _, r in lines if r]
    assert R.load_with_rejects(df.where("false"), "line_id", "line").count() == 0
