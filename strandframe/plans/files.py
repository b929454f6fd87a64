"""Queries that write whole tables in each file format and read them again, and streams over such files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.functions import dna
from strandframe.operators import pairs as P
from strandframe.operators.chains import mapped_intervals
from strandframe.operators.shimmers import ShimmerSpec, shimmers
from strandframe.plans import catalog as C
from strandframe.plans.kernels import _SKETCH
from strandframe.plans.relational import _ALL_EDGES, _BED, _PAIRS, _SEQS
from strandframe.session import durable_dir
from strandframe.sources import readers as R, writers as W
from strandframe.streaming import reads as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


def _folder(spark: SparkSession, name: str = "") -> str:
    """A folder in the checkpoint folder, deleted when the session's JVM ends."""
    where = f"{durable_dir(spark)}/files-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{where}/{name}" if name else where


def _seqs(spark: SparkSession, base: str) -> DataFrame:
    return C.sequences(spark, base).where("seq IS NOT NULL").select("sid", "name", "seq")


def _fastq(df: DataFrame, path: str) -> str:
    df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.expr("repeat('I', length(seq))")).alias("value")).write.text(path)
    return path


# ------------------------------------------------------------------ sequences


@query(f"WITH {_SEQS} SELECT name, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS seq FROM seqs WHERE seq IS NOT NULL")
def io_fasta(spark, base):
    path = _folder(spark)
    W.fasta(_seqs(spark, base).withColumn("turned", F.lit(1)), path, turned="turned")
    return R.fasta(spark, path).select("name", "seq")


@query(f"WITH {_SEQS} SELECT name, seq FROM seqs WHERE seq IS NOT NULL")
def io_fastq(spark, base):
    return R.fastq(spark, _fastq(_seqs(spark, base), _folder(spark)))


@query(f"WITH {_SEQS}, two AS (SELECT name, 'first' AS source, seq FROM seqs WHERE seq IS NOT NULL UNION ALL SELECT name, 'second', seq FROM seqs WHERE seq IS NOT NULL) SELECT CAST(row_number() OVER (ORDER BY source, name) + 6 AS INTEGER) AS sid, name, source, length(seq) AS len FROM two")
def io_sequences(spark, base):
    """Two files with the same names, numbered on from 7."""
    fa, fq = _folder(spark, "first.fa"), _folder(spark, "second.fq")
    W.fasta(_seqs(spark, base), fa)
    _fastq(_seqs(spark, base), fq)
    return R.sequences(spark, [fa, fq], 7).select("sid", "name", "source", "len")


@query(f"WITH {_SEQS} SELECT sid, name, upper(trim(source)) AS source, length(seq) AS len FROM seqs WHERE upper(trim(source)) = 'PX027'")
def io_store(spark, base):
    """Sequences stored by source, read from one source's folder alone."""
    path = _folder(spark)
    W.sequence_store(C.sequences(spark, base).withColumn("source", F.coalesce(F.upper(F.trim("source")), F.lit("none"))), path)
    return spark.read.parquet(path).where("source = 'PX027'").select("sid", "name", "source", F.length("seq").alias("len"))


# ------------------------------------------------------------------ index


@query(f"WITH {_SEQS} SELECT sid, length(seq) AS len, name AS ctg, CASE WHEN source <> '-' THEN source END AS source FROM seqs")
def io_midx(spark, base):
    path = _folder(spark)
    W.midx(C.sequences(spark, base).select("sid", "name", "source", F.length("seq").alias("len")), path)
    return R.midx(spark, path)


@query(f"WITH {_PAIRS} SELECT h0, h1, sid, bgn, end_pos, orientation FROM pairs WHERE h0 = (SELECT min(h0) FROM pairs)")
def io_index(spark, base):
    """The stored pair table, of which a probe reads the row groups of its key."""
    path = _folder(spark)
    W.index(C.pairs(spark, base), path, 4)
    index = spark.read.parquet(path)
    return P.postings(index.where(F.col("h0") == index.agg(F.min("h0")).first()[0]))


@query(f"WITH {_PAIRS}, cat AS (SELECT sid, name, source, length(seq) AS len FROM (SELECT DISTINCT sid, name, source, seq FROM sequences)) SELECT concat_ws(chr(9), 'F', lower(lpad(hex(h0), 16, '0')) || '_' || lower(lpad(hex(h1), 16, '0')), ord, sid, bgn, end_pos, orientation) AS line FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY sid ORDER BY ord) - 1 AS ord) FROM pairs) UNION ALL SELECT concat_ws(chr(9), 'C', sid, name, coalesce(source, 'NA'), len) FROM cat UNION ALL SELECT concat_ws(chr(9), 'K', 80, 56, 4, 64, 'true')")
def io_map_index(spark, base):
    from pyspark.sql import Window

    path = _folder(spark)
    numbered = C.pairs(spark, base).withColumn("ord", F.row_number().over(Window.partitionBy("sid").orderBy("ord")) - 1)
    W.map_index(numbered, C.sequences(spark, base).select("sid", "name", "source", F.length("seq").alias("len")), (80, 56, 4, 64, True), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {_ALL_EDGES}, ids AS (SELECT h0, h1, CAST(row_number() OVER (ORDER BY h0, h1) - 1 AS VARCHAR) AS id FROM (SELECT DISTINCT h0, h1 FROM pairs)), sup AS (SELECT v_h0, v_h1, v_ori, w_h0, w_h1, w_ori, CAST(count(*) AS INTEGER) AS w FROM e WHERE v_h0 <= w_h0 GROUP BY ALL) SELECT v.id AS a, z.id AS b, w FROM sup JOIN ids v ON v.h0 = v_h0 AND v.h1 = v_h1 JOIN ids z ON z.h0 = w_h0 AND z.h1 = w_h1")
def io_gfa(spark, base):
    path = _folder(spark)
    pairs = C.pairs(spark, base)
    W.gfa(P.segments(pairs, 56), P.gfa_links(P.edges(pairs)), 56, path)
    return R.gfa_links(spark, path)


# ------------------------------------------------------------------ intervals and annotations


@query(f"WITH {_BED} SELECT ctg, bgn, end_pos, b_id, b_size, b_direction, b_bgn, b_end, r_type FROM bed WHERE b_id IS NOT NULL AND r_type IS NOT NULL")
def io_bundle_bed(spark, base):
    path = _folder(spark)
    runs = C.stretches(spark, base).where("b_id IS NOT NULL AND r_type IS NOT NULL").withColumnsRenamed({"b_id": "bundle_id", "b_size": "size", "b_direction": "dir", "b_bgn": "v_bgn", "b_end": "v_end", "r_type": "flag"})
    W.bundle_bed_lines(runs).write.text(path)
    return R.bundle_bed(spark, path)


_GFF_ROWS = "gff AS (SELECT DISTINCT rec_id, seqid, type_name, bgn, end_pos FROM gff_records WHERE seqid IS NOT NULL AND type_name IS NOT NULL AND bgn IS NOT NULL AND end_pos IS NOT NULL)"


def _gff(spark, base):
    rows = spark.read.parquet(f"{base}/gff_records.parquet").select("rec_id", "seqid", "type_name", "bgn", "end_pos").distinct()
    return rows.where("seqid IS NOT NULL AND type_name IS NOT NULL AND bgn IS NOT NULL AND end_pos IS NOT NULL")


@query(f"WITH {_GFF_ROWS} SELECT seqid AS chr, bgn AS b_bgn, end_pos AS b_end, 'gene' || rec_id AS gene FROM gff WHERE type_name = 'mRNA'")
def io_gtf(spark, base):
    path = _folder(spark)
    attributes = F.concat(F.lit('gene_id "g'), "rec_id", F.lit('"; gene_name "gene'), "rec_id", F.lit('";'))
    W.tsv(_gff(spark, base).select("seqid", F.lit("s"), "type_name", "bgn", "end_pos", F.lit("."), F.lit("+").alias("strand"), F.lit(".").alias("frame"), attributes.alias("attributes")).toDF(*"abcdefghi"), path)
    return R.gtf(spark, path, "mRNA").select("chr", "b_bgn", "b_end", "gene")


@query(f"WITH {_GFF_ROWS} SELECT seqid, type_name, CAST(bgn AS BIGINT) AS bgn, CAST(end_pos AS BIGINT) AS end_pos, 'r' || rec_id AS id, 'n ' || rec_id AS name, CAST(NULL AS VARCHAR) AS parent FROM gff")
def io_gff3(spark, base):
    path = _folder(spark)
    attributes = F.concat(F.lit("ID=r"), "rec_id", F.lit("; Name = n "), "rec_id", F.lit(";"))
    W.tsv(_gff(spark, base).select("seqid", F.lit("s"), "type_name", "bgn", "end_pos", F.lit("."), F.lit("+").alias("strand"), F.lit(".").alias("phase"), attributes.alias("attributes")).toDF(*"abcdefghi"), path)
    return R.gff3(spark, path).select("seqid", "type_name", "bgn", "end_pos", "id", "name", "parent")


@query(f"WITH {_GFF_ROWS} SELECT 'r' || rec_id AS label, 's' AS source, seqid AS ctg, bgn, end_pos, CAST(rec_id % 2 AS INTEGER) AS strand FROM gff")
def io_regions(spark, base):
    path = _folder(spark)
    W.tsv(_gff(spark, base).select(F.concat(F.lit("r"), "rec_id"), F.lit("s"), "seqid", "bgn", "end_pos", F.when(F.col("rec_id") % 2 == 1, 1)).toDF(*"abcdef"), path)
    return R.regions(spark, path)


@query(f"WITH {_GFF_ROWS} SELECT 'r' || rec_id AS label, CASE WHEN rec_id % 2 = 1 THEN reverse(translate(part, 'ACGTacgt', 'TGCAtgca')) ELSE part END AS seq FROM (SELECT rec_id, substr(seq, bgn, end_pos - bgn + 1) AS part FROM gff JOIN (SELECT DISTINCT name, seq FROM sequences) ON name = seqid WHERE bgn >= 1 AND bgn <= end_pos AND seq IS NOT NULL)")
def fetch_regions(spark, base):
    """The bases of all annotated stretches, reverse complemented where the strand is 1."""
    from strandframe.plans.pangenome import Pangenome

    p = Pangenome(C.sequences(spark, base).where("seq IS NOT NULL").withColumn("source", F.lit("s")))
    asked = _gff(spark, base).where("bgn >= 1 AND bgn <= end_pos").select(F.concat(F.lit("r"), "rec_id").alias("label"), F.lit("s").alias("source"), F.col("seqid").alias("ctg"), (F.col("bgn") - 1).alias("bgn"), "end_pos", (F.col("rec_id") % 2).alias("strand"))
    return p.fetch(asked)


@query("SELECT c_name AS chr, CAST(c_custkey AS INTEGER) AS pos, c_mktsegment AS ref, CAST(c_nationkey AS VARCHAR) AS alt, '0|1' AS sample FROM customer")
def io_vcf(spark, base):
    path = _folder(spark)
    rows = spark.read.parquet(f"{base}/customer.parquet").select(F.col("c_name").alias("t_name"), F.col("c_custkey").cast("int").alias("pos"), F.col("c_mktsegment").alias("ref"), F.col("c_nationkey").cast("string").alias("alt"), F.lit("0|1").alias("gt"))
    W.vcf(rows, rows.select("t_name", F.lit(9).alias("len")), "me", path)
    return R.vcf(spark, path).select("chr", "pos", "ref", "alt", "sample")


@query("SELECT CAST(o_orderkey AS INTEGER) AS block_id, o_orderstatus AS t_name, CAST(o_custkey AS INTEGER) AS b_bgn, CAST(o_custkey + 100 AS INTEGER) AS b_end FROM orders")
def io_alnmap(spark, base):
    """Begin and end records of blocks, joined again by block."""
    path = _folder(spark)
    rows = spark.read.parquet(f"{base}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_custkey").alias("s"), (F.col("o_custkey") + 100).alias("e"))
    line = lambda k: F.concat_ws("\t", F.col("id").cast("string"), F.lit(k), "o_orderstatus", F.col("s").cast("string"), F.col("e").cast("string"), F.lit("q"), F.lit("1"), F.lit("5"), F.lit("0"), F.lit("100"), F.lit("0"))
    rows.select(F.explode(F.array(line("B"), line("E"))).alias("value")).write.text(path)
    return R.block_intervals(R.alnmap(spark, path))


@query("SELECT n_name AS name, n_regionkey AS w FROM nation WHERE starts_with(n_name, (SELECT left(min(n_name), 1) FROM nation))")
def io_presets(spark, base):
    """A document of presets, searched by the begin of their names."""
    path = _folder(spark)
    nation = spark.read.parquet(f"{base}/nation.parquet").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("w"))
    nation.agg(F.to_json(F.collect_list(F.struct("name", "w"))).alias("value")).write.text(path)  # one document, as presets are kept
    return R.preset_search(R.json_rows(spark, path, "name string, w int"), nation.agg(F.min("name")).first()[0][:1])


@query(f"WITH {_BED}, once AS (SELECT ctg, b_id, b_direction, min(bgn) AS pos FROM bed WHERE b_id IS NOT NULL GROUP BY ctg, b_id, b_direction HAVING count(*) = 1), pair AS (SELECT b_id, ctg, count(*) AS n, min(pos) AS bgn, max(pos) AS end_pos FROM once GROUP BY b_id, ctg) SELECT 0 AS q_sid, b_id AS name, ctg AS sid, bgn, end_pos, 0 AS orientation FROM pair WHERE n = 2")
def intervals_mapped(spark, base):
    """Bundles of which both directions stand exactly once in a contig, as intervals whose two ends are mapped."""
    bed = C.stretches(spark, base).where("b_id IS NOT NULL")
    return mapped_intervals(bed.select(F.lit(0).alias("q_sid"), F.col("b_id").alias("name"), F.col("b_direction").alias("side"), F.col("ctg").alias("sid"), F.col("bgn").alias("pos"), F.lit(0).alias("orientation")))


# ------------------------------------------------------------------ streams

_SPEC = ShimmerSpec(80, 24, 1, 8, True)


def _streamed(spark, base):
    path = _folder(spark)
    _fastq(_seqs(spark, base), path)
    return S.fastq_stream(spark, path)


@query(f"WITH {_SKETCH}, known AS (SELECT DISTINCT hash FROM sketch WHERE sid % 50 = 0) SELECT name FROM seqs JOIN (SELECT sid FROM sketch LEFT JOIN known USING (hash) GROUP BY sid HAVING count(known.hash) > 0.8 * count(*)) USING (sid)".replace("LEFT JOIN known USING (hash)", "s LEFT JOIN known ON s.hash = known.hash"))
def stream_filter(spark, base):
    """Reads of a stream of which most marks are in the set of the sequences whose id is divisible by 50."""
    known = shimmers(_seqs(spark, base).where("sid % 50 = 0"), _SPEC)
    out = _folder(spark, "out")
    q = S.filter_stream(_streamed(spark, base), known, _SPEC, out, _folder(spark, "log"))
    q.processAllAvailable()
    q.stop()
    return spark.read.schema("name string, seq string").parquet(f"{out}/batch=*").select("name")


@query(f"WITH {_SKETCH} SELECT hash, count(*) AS n FROM sketch GROUP BY hash")
def stream_counts(spark, base):
    """Running counts of marks after the last batch, from the changed rows that each batch writes."""
    out = _folder(spark, "out")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    q = S.count_stream(_streamed(spark, base), _SPEC).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", _folder(spark, "log")).start()
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{out}/batch=*").groupBy("hash").agg(F.max_by("n", "epoch").alias("n"))


# ------------------------------------------------------------------ columns


@query("SELECT line_id, regexp_extract(file_name, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, CAST((line_id * 57) % 59 AS BIGINT) AS a, CAST(93 - (line_id * 31) % 47 AS BIGINT) AS b FROM (SELECT DISTINCT line_id, file_name FROM gff_lines WHERE file_name IS NOT NULL)")
def names_and_hues(spark, base):
    rows = spark.read.parquet(f"{base}/gff_lines.parquet").where("file_name IS NOT NULL").select("line_id", "file_name").distinct()
    hue = dna.hue("line_id")
    return rows.select("line_id", dna.file_stem("file_name").alias("stem"), hue["a"].cast("long").alias("a"), hue["b"].cast("long").alias("b"))


@query(f"WITH {_SEQS} SELECT sid, lower(hex(encode(seq))) AS raw, seq AS back, name || '::' || sid || '_0_' || length(seq) || '_1' AS region FROM seqs WHERE seq IS NOT NULL")
def bytes_and_regions(spark, base):
    s = _seqs(spark, base)
    region = dna.region_name(F.col("name"), F.col("sid").cast("string"), F.lit("0"), F.length("seq").cast("string"), F.lit("1"))
    return s.select("sid", F.lower(F.hex(dna.to_bytes("seq"))).alias("raw"), dna.from_bytes(dna.to_bytes("seq")).alias("back"), region.alias("region"))
