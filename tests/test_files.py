"""Readers, writers, streams, the collection and the driver's contract."""

from __future__ import annotations

import gzip
import struct

import pytest
from helpers import rows
from pyspark.sql import functions as F

import __spark_entry__
from strandframe.operators.shimmers import ShimmerSpec, shimmers
from strandframe.plans.pangenome import Pangenome, register_sql
from strandframe.sources import readers as R, writers as W
from strandframe.streaming import reads as S


def test_fasta_and_fastq(spark, tmp_path):
    fa = tmp_path / "one.fa.gz"
    fa.write_bytes(gzip.compress(b">a x>y\nAC\nGT\r\n>b\n\n>c\nTT"))
    assert rows(R.fasta(spark, str(fa)), "name", "source", "seq") == [("a", "one", "ACGT"), ("b", "one", ""), ("c", "one", "TT")]
    fq = tmp_path / "two.fq"
    fq.write_text("@r1 x\nACGT\n+\n@@@@\n@r2\nGG\n+r2\nII\n@r3\nTTT\n+\n@II")
    assert rows(R.fastq(spark, str(fq))) == [("r1", "ACGT"), ("r2", "GG"), ("r3", "TTT")]
    assert (R.sniff(spark, str(fa)), R.sniff(spark, str(fq))) == ("fasta", "fastq")
    both = R.sequences(spark, [str(fa), str(fq)], 5)
    assert sorted(r.sid for r in both.collect()) == [5, 6, 7, 8, 9, 10]
    (tmp_path / "twice.fa").write_text(">a\nAC\n>a\nGT\n>a\nAC\n")
    assert [(r[0], *r[1:3]) for r in rows(R.sequences(spark, [str(tmp_path / "twice.fa")]))] == [(i, "a", "twice") for i in range(3)]
    out = tmp_path / "out"
    W.fasta(spark.createDataFrame([("n", "ACGG", 1), ("m", "AC", 0)], "name string, seq string, o int"), str(out), turned="o")
    assert rows(R.fasta(spark, str(out)), "name", "seq") == [("m", "AC"), ("n", "CCGT")]


def test_tables(spark, tmp_path):
    def file(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    assert rows(R.midx(spark, file("m", "0\t10\tc1\tS\n1\t20\tc2\t-\n"))) == [(0, 10, "c1", "S"), (1, 20, "c2", None)]
    assert rows(R.bundle_bed(spark, file("b", "# x\nc\t1\t9\t3:4:0:5:6:R\nc\t9\t12\t1:2:1:0:1\n\n"))) == [("c", 1, 9, 3, 4, 0, 5, 6, "R"), ("c", 9, 12, 1, 2, 1, 0, 1, None)]
    assert rows(R.gtf(spark, file("g", 'c\ts\ttranscript\t1\t9\t.\t+\t.\tgene_id "G"; gene_name "N";\nc\ts\texon\t1\t9\t.\t+\t.\tx "y";\n')), "b_bgn", "gene") == [(1, "N")]
    assert rows(R.vcf(spark, file("v", "##x\n#CHROM\nc\t5\t.\tA\tG\t60\tPASS\t.\tGT\t0|1\n")), "pos", "sample") == [(5, "0|1")]
    assert rows(R.regions(spark, file("r", "l\ts\tc\t1\t5\nm\ts\tc\t1\t5\t1\n")), "label", "strand") == [("l", 0), ("m", 1)]
    assert rows(R.gfa_links(spark, file("l", "H\tVN\nL\ta\t+\tb\t-\t56M\tSC:i:7\nL\tb\t+\tc\t-\t56M\n"))) == [("a", "b", 7), ("b", "c", 1)]
    aln = R.alnmap(spark, file("a", "0\tB\tt\t5\t9\tq\t1\t5\t0\t100\t0\n0\tV\tt\t5\t9\tq\t1\t5\t0\t2\t2\t7\tX\tA\tG\n0\tS\tt\t5\t9\tq\t1\t5\t0\t1\tL\n0\tE\tt\t20\t30\tq\t1\t5\t0\t100\t0\n"))
    assert rows(aln.where("rec_type = 'V'"), "td", "tc", "t_str") == [(2, 7, "A")] and rows(aln.where("rec_type = 'S'"), "ctg_orientation", "diff_type") == [(1, "L")]
    assert rows(R.block_intervals(aln)) == [(0, "t", 5, 30)]
    j = R.json_rows(spark, file("j", '[{"name": "r1", "w": 5},\n {"name": "q2"}]'), "name string, w int")
    assert rows(R.preset_search(j, "r")) == [("r1", 5)]
    raw = b"mdb" + struct.pack("<5I", 80, 56, 4, 64, 1) + struct.pack("<Q", 1) + struct.pack("<QQQ", 7, 9, 2) + struct.pack("<IIIIB", 0, 1, 2, 3, 0) + struct.pack("<IIIIB", 4, 5, 6, 7, 1)
    (tmp_path / "i.mdb").write_bytes(raw)
    assert rows(R.index_records(spark, str(tmp_path / "i.mdb"))) == [(7, 9, 0, 1, 2, 3, 0), (7, 9, 4, 5, 6, 7, 1)]
    g = spark.createDataFrame([("t", 5, "A", "G", "0|1")], "t_name string, pos int, ref string, alt string, gt string")
    W.vcf(g, spark.createDataFrame([("t", 99)], "t_name string, len int"), "me", str(tmp_path / "vcf"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "vcf")).collect()]
    assert lines[0].startswith("##fileformat") and "##contig=<ID=t,length=99>" in lines and lines[-1] == "t\t5\t.\tA\tG\t60\tPASS\t.\tGT\t0|1"
    assert rows(R.with_ids(spark.range(50).withColumn("k", F.pmod(F.col("id") * 7, F.lit(50))).select("k"), ["k"], "n", 3)) == [(i, i + 3) for i in range(50)]


def test_collection(spark, tmp_path):
    import random

    rnd = random.Random(1)
    base = "".join(rnd.choice("ACGT") for _ in range(2500))
    p = Pangenome.from_list(spark, [("a", base), ("b", base[:1200] + "A" + base[1200:]), ("c", base[400:])], spec=ShimmerSpec(20, 15, 1, 4, True))
    assert p.subsequence("Memory", "a", 10, 20).first().seq == base[10:20] and p.subsequence_by_id(1, 0, 5).first().seq == base[:5] and p.sequence_by_id(2).first().seq == base[400:]
    fetched = p.fetch(spark.createDataFrame([("x", "Memory", "a", 0, 4, 1)], "label string, source string, ctg string, bgn int, end_pos int, strand int")).first().seq
    assert fetched == base[:4].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    q = p.sequences.where("sid = 2").select("sid", "seq")
    assert {r.sid for r in p.query(q).collect()} == {0, 1, 2}
    p.save(str(tmp_path / "store"))
    again = Pangenome.from_store(spark, str(tmp_path / "store"))
    assert rows(again.pairs) == rows(p.pairs) and again.spec == p.spec and rows(again.sequences.select("sid", "seq")) == rows(p.sequences.select("sid", "seq"))
    p.write_gfa(str(tmp_path / "gfa"))
    kinds = {r.value[0] for r in spark.read.text(str(tmp_path / "gfa")).collect()}
    assert kinds == {"H", "S", "L"}
    register_sql(spark)
    p.sequences.createOrReplaceTempView("seqs")
    assert spark.sql("SELECT sid, m.* FROM seqs, LATERAL shimmer_marks(seq, 20, 15, 1, 4, true) m").count() == p.marks.count()


def test_trees_maps_and_lengths(spark, tmp_path):
    import json

    from strandframe.operators.bundles import average_linkage
    from strandframe.operators.overlap import tiling

    merges, _ = average_linkage(["a", "b", "c"], {("a", "b"): 0.5, ("a", "c"): 0.2, ("b", "c"): 0.9})
    (tmp_path / "t.ddg").write_text("\n".join(W.dendrogram_lines(["a", "b", "c"], merges)) + "\n")
    tree = R.dendrogram(spark, str(tmp_path / "t.ddg"))
    assert rows(tree.where("kind = 'I'"), "node", "left", "right", "size", "height") == [(3, 0, 2, 2, 0.2), (4, *sorted((1, 3)), 3, pytest.approx(0.7))]
    places = {r.node: r.x for r in tree.where("kind = 'P'").collect()}
    assert sorted(places[i] for i in range(3)) == [0, 1, 2] and places[4] == 1.0 and places[3] == (places[0] + places[2]) / 2
    assert {r.name for r in tree.where("kind = 'L'").collect()} == {"a", "b", "c"}
    cat = spark.createDataFrame([(1, 'x"y', 5), (0, "z", 7)], "sid int, name string, len int")
    W.lengths_json(cat, str(tmp_path / "len"))
    assert json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "len")).collect())) == [[0, "z", 7], [1, 'x"y', 5]]
    e = spark.createDataFrame([("t", 1, 5, "q", 2, 6, 9, 0, 1, False, True, False, False)], "t_name string, ts int, te int, q_name string, qs int, qe int, q_len int, orientation int, ctg_orientation int, t_dup boolean, t_ovlp boolean, q_dup boolean, q_ovlp boolean")
    assert W.contig_map_lines(e).first().value == "t\t1\t5\tq:2:6:9:0:1:false:true:false:false"
    tiles = tiling(spark.createDataFrame([("t", 3, 9, 7)], "t_name string, ts int, te int, block_id int"), lengths=spark.createDataFrame([("t", 12)], "t_name string, len int"))
    assert rows(W.tile_lines(tiles, "T")) == [("t\t0\t3\tTG:7",), ("t\t9\t12\tTG:END",)]


def test_bases_are_mapped_on_both_strands(spark):
    import random

    rnd = random.Random(4)
    base = "".join(rnd.choice("ACGT") for _ in range(3000))
    other = base[:800] + "ACG" + base[800:1500] + base[1502:]
    back = other.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    p = Pangenome.from_list(spark, [("other", other), ("back", back)], spec=ShimmerSpec(20, 15, 1, 4, True))
    q = spark.createDataFrame([(9, base)], "sid int, seq string")
    asked = [100, 790, 900, 1400, 1600, 2500]
    got = p.map_bases(q, spark.createDataFrame([(9, x) for x in asked], "q_sid int, pos int")).collect()
    place = lambda x: x + (3 if x >= 800 else 0) - (2 if x >= 1502 else 0)
    assert {(r.sid, r.pos): (r.t_pos, r.orientation, r.same) for r in got} == {(s, x): (place(x) if s == 0 else len(other) - 1 - place(x), s, True) for s in (0, 1) for x in asked}


def test_command_line(spark, tmp_path):
    import random

    from strandframe import __main__ as cli

    rnd = random.Random(2)
    base = "".join(rnd.choice("ACGT") for _ in range(4000))
    (tmp_path / "a.fa").write_text(f">x\n{base}\n>x\n{base[:2500]}\n>y\n{base[500:]}\n>z\n{base[::-1]}\n")
    (tmp_path / "q.fa").write_text(f">q\n{base[1000:2000]}\n")
    (tmp_path / "r.txt").write_text("part\ta\ty\t0\t20\t1\n")
    (tmp_path / "names").write_text("x\ny\n")
    at = lambda n: str(tmp_path / n)
    cli.run(spark, ["build-index", at("store"), at("a.fa"), "--k", "24", "--r", "1", "--min-span", "8"])
    cli.run(spark, ["list", at("store"), at("list")])
    listed = rows(spark.read.option("sep", "\t").csv(at("list")))
    assert [(r[1], r[2], r[3]) for r in listed] == [("a", "x", "2500"), ("a", "x", "4000"), ("a", "y", "3500"), ("a", "z", "4000")] or sorted(r[3] for r in listed) == ["2500", "3500", "4000", "4000"]
    assert len({r[0] for r in listed}) == 4
    cli.run(spark, ["fetch", at("store"), at("r.txt"), at("fetched")])
    assert rows(R.fasta(spark, at("fetched")), "name", "seq") == [("part", base[500:520].translate(str.maketrans("ACGT", "TGCA"))[::-1])]
    cli.run(spark, ["query", at("store"), at("q.fa"), at("hits"), "--merge", "100"])
    hits = spark.read.option("sep", "\t").option("header", True).csv(at("hits.hit"))
    assert len(hits.columns) == 12 and rows(hits.select("ctg").distinct()) == [("x",), ("y",)]
    got = {r.name: r.seq for r in R.fasta(spark, at("hits.fa")).collect()}
    assert got and all(s in base for s in got.values()) and any(len(s) > 700 for s in got.values())
    cli.run(spark, ["decompose", at("store"), at("out"), "--include", at("names"), "--min-branch", "2", "--min-length", "100"])
    assert {r.ctg for r in R.bundle_bed(spark, at("out.bed")).collect()} == {"x", "y"}
    assert R.gfa_links(spark, at("out.gfa")).count() > 0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spec = ShimmerSpec(20, 15, 1, 4, True)
    good, bad = "ACGTTGCAAGGCTATTCGGA" * 9 + "CATGCCGATTTAGCGC" * 6, "TTGACCAGTAGCCCAATGTC" * 12
    (tmp_path / "in" / "a.fq").write_text(f"@g\n{good}\n+\n{'I' * len(good)}\n@b\n{bad}\n+\n{'I' * len(bad)}\n")
    known = shimmers(spark.createDataFrame([("k", good)], "name string, seq string"), spec, key="name")
    q = S.filter_stream(S.fastq_stream(spark, str(tmp_path / "in")), known, spec, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "name") == [("g",)]
    counts = S.count_stream(S.fastq_stream(spark, str(tmp_path / "in")), spec).writeStream.outputMode("complete").format("memory").queryName("mark_counts").start()
    counts.processAllAvailable()
    counts.stop()
    assert spark.table("mark_counts").agg(F.sum("n")).first()[0] == known.count() + shimmers(spark.createDataFrame([("b", bad)], "name string, seq string"), spec, key="name").count()


def test_contract():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and {"p3_found", "p4_found", "p5_found", "p7_found"} <= set(queries)
