"""Queries of the relational operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.functions import dna
from strandframe.operators import bundles as B, chains as H, kmers as N, overlap as V, pairs as P
from strandframe.plans import catalog as C
from strandframe.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MARKS = """marks AS (SELECT DISTINCT sid, ord, CAST((CAST(x AS HUGEINT) + CASE WHEN x < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END) // 256 AS BIGINT) AS hash,
  CAST(x & 255 AS INTEGER) AS span, CAST((y & 4294967295) >> 1 AS INTEGER) AS pos, CAST(y & 1 AS INTEGER) AS strand FROM shimmers WHERE x IS NOT NULL AND NOT (x = -1 AND y IS NOT DISTINCT FROM -1))"""
_NEIGHBOURS = f"""{_MARKS}, nb AS (SELECT sid, ord, hash AS a, pos, lead(hash) OVER (PARTITION BY sid ORDER BY ord) AS b, lead(pos) OVER (PARTITION BY sid ORDER BY ord) AS npos FROM marks)"""
_PAIRS = f"""{_NEIGHBOURS}, pairs AS (SELECT sid, ord, least(a, b) AS h0, greatest(a, b) AS h1, pos + 1 AS bgn, npos + 1 AS end_pos, CAST(a > b AS INTEGER) AS orientation FROM nb WHERE b IS NOT NULL)"""
_ASKED = f"""{_PAIRS}, q AS (SELECT sid AS q_sid, ord, least(a, b) AS h0, greatest(a, b) AS h1, pos + 1 AS q_bgn, npos + 1 AS q_end, CAST(a >= b AS INTEGER) AS q_orientation FROM nb WHERE b IS NOT NULL AND sid % 50 = 0)"""
_SEQS = "seqs AS (SELECT DISTINCT sid, name, source, seq FROM sequences)"
_CATALOG = "cat AS (SELECT DISTINCT sid, name, upper(trim(source)) AS source FROM sequences)"
_BED = "bed AS (SELECT DISTINCT * EXCLUDE (loaded_at) REPLACE (trim(ctg) AS ctg) FROM bundle_bed WHERE ctg IS NOT NULL AND bgn < end_pos)"
_GFF = """gff AS (SELECT DISTINCT rec_id, trim(seqid) AS chr, type_name, bgn - 1 AS b_bgn, end_pos AS b_end,
  trim(coalesce(regexp_extract(attributes, 'Name *[= ] *"?([^";,|]*)', 1), '')) AS name FROM gff_records WHERE seqid IS NOT NULL AND bgn <= end_pos)"""


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _asked(spark: SparkSession, base: str) -> DataFrame:
    """The query set: the pairs of every sequence whose id is divisible by 50, against all."""
    return C.pairs(spark, base, query=True).where("sid % 50 = 0")


# ------------------------------------------------------------------ sequences


@query(f"WITH {_SEQS} SELECT sid, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc FROM seqs")
def seq_revcomp(spark, base):
    return C.sequences(spark, base).select("sid", dna.reverse_complement("seq").alias("rc"))


@query(f"WITH {_SEQS} SELECT sid, substring(seq, 101, 150) AS part FROM seqs")
def seq_subseq(spark, base):
    return C.sequences(spark, base).select("sid", dna.subsequence("seq", F.lit(100), F.lit(250)).alias("part"))


@query(f"WITH {_SEQS} SELECT name, source, seq FROM seqs WHERE source = 'PX027'")
def seq_fetch(spark, base):
    return C.sequences(spark, base).where(F.col("source") == "PX027").select("name", "source", "seq")


@query(f"WITH {_SEQS}, k AS (SELECT substr(upper(seq), CAST(i AS INTEGER), 12) AS kmer FROM seqs, LATERAL (SELECT unnest(range(1, length(seqs.seq) - 10)) AS i)) SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_count(spark, base):
    return N.kmer_counts(C.sequences(spark, base).select("sid", F.upper("seq").alias("seq")), 12)


@query(f"WITH {_SEQS}, b AS (SELECT translate(upper(seq), 'ACGT', '0101') AS low, translate(upper(seq), 'ACGT', '0011') AS high, sid FROM seqs) SELECT sid, low, high FROM b")
def seq_bit_planes(spark, base):
    planes = dna.bit_planes("seq")
    return C.sequences(spark, base).select("sid", planes["low"].alias("low"), planes["high"].alias("high"))


@query(f"WITH {_CATALOG} SELECT source, count(*) AS n_ctgs FROM cat GROUP BY source")
def catalog_contigs(spark, base):
    return C.catalog(spark, base).groupBy("source").agg(F.count("*").alias("n_ctgs"))


@query(f"WITH {_SEQS}, l AS (SELECT name, length(seq) AS length FROM seqs) SELECT name, length, CAST(coalesce(sum(length + 1000) OVER (ORDER BY length DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM l")
def layout_offsets(spark, base):
    return V.layout_offsets(C.sequences(spark, base).select("name", F.length("seq").alias("length")), 1000)


# ------------------------------------------------------------------ marks and pairs


@query(f"WITH {_MARKS} SELECT sid, ord, hash, span, pos, strand FROM marks")
def marks_unpacked(spark, base):
    return C.marks(spark, base)


@query(f"WITH {_PAIRS} SELECT sid, ord, h0, h1, bgn, end_pos, orientation FROM pairs")
def shimmer_pairs(spark, base):
    return C.pairs(spark, base)


@query(f"WITH {_PAIRS} SELECT h0, h1, count(*) AS n, lower(lpad(hex(h0), 16, '0')) || '_' || lower(lpad(hex(h1), 16, '0')) AS name FROM pairs GROUP BY h0, h1")
def pair_counts(spark, base):
    return P.pair_counts(C.pairs(spark, base)).withColumn("name", dna.pair_name("h0", "h1"))


@query(f"WITH {_PAIRS}, {_CATALOG} SELECT h0, h1, source, count(*) AS n FROM pairs JOIN cat USING (sid) GROUP BY h0, h1, source")
def pair_source_counts(spark, base):
    return P.pair_source_counts(C.pairs(spark, base), C.catalog(spark, base))


@query(f"WITH {_PAIRS}, {_CATALOG}, s AS (SELECT h0, h1, source, count(*) AS n FROM pairs JOIN cat USING (sid) GROUP BY h0, h1, source) SELECT h0, h1, count(*) AS n_sources FROM s WHERE n <= 1 GROUP BY h0, h1")
def pair_unique_sources(spark, base):
    return P.pair_unique_sources(C.pairs(spark, base), C.catalog(spark, base), 1)


@query(f"WITH {_PAIRS} SELECT h0, h1, count(*) AS n FROM pairs GROUP BY h0, h1 HAVING count(*) >= 4")
def frequent_pairs(spark, base):
    return P.frequent_pairs(C.pairs(spark, base), 4)


@query(f"WITH {_ASKED}, c AS (SELECT h0, h1, count(*) AS n FROM pairs GROUP BY h0, h1) SELECT q_sid, q_bgn, q_end, h0, h1, coalesce(n, 0) AS n FROM q LEFT JOIN c USING (h0, h1)")
def query_hits(spark, base):
    return P.hit_counts(_asked(spark, base), C.pairs(spark, base))


_FILTERED = f"""{_ASKED}, c AS (SELECT h0, h1, sid, count(*) AS t, sum(count(*)) OVER (PARTITION BY h0, h1) AS w FROM pairs GROUP BY h0, h1, sid),
hit AS (SELECT q_sid, sid, q_bgn, q_end, q_orientation, bgn, end_pos, orientation FROM q JOIN pairs USING (h0, h1) JOIN c USING (h0, h1, sid) WHERE w <= 128 AND t <= 128)"""


@query(f"WITH {_FILTERED} SELECT * FROM hit")
def query_hits_filtered(spark, base):
    return P.suppressed_hits(_asked(spark, base), C.pairs(spark, base))


_HIT = f"{_ASKED}, hit AS (SELECT q.h0, q.h1, q_sid, q_bgn, q_end, q_orientation, sid, bgn, end_pos, orientation FROM q LEFT JOIN pairs USING (h0, h1))"


@query(f"WITH {_HIT} SELECT * FROM hit")
def query_fragments(spark, base):
    return P.hits(_asked(spark, base), C.pairs(spark, base))


@query(f"WITH {_HIT} SELECT q_sid, sid, bgn, end_pos, CASE WHEN orientation = q_orientation THEN 0 ELSE 1 END AS relative FROM hit WHERE sid IS NOT NULL")
def match_positions(spark, base):
    return P.match_positions(_asked(spark, base), C.pairs(spark, base))


@query(f"WITH {_MARKS} SELECT sid, x, y FROM (SELECT a.sid, a.pos AS x, b.pos AS y FROM marks a JOIN marks b ON a.sid = b.sid AND a.hash = b.hash)")
def self_dots(spark, base):
    """Equal marks of each sequence with itself. A repeat of n places gives n x n points, which is the plot."""
    m = C.marks(spark, base)
    return P.dots(m, m, ["sid"])


@query(f"WITH {_PAIRS}, c AS (SELECT h0, h1 FROM pairs GROUP BY h0, h1 HAVING count(*) >= 3) SELECT h0, h1, sid, ord, bgn, end_pos, orientation FROM pairs LEFT JOIN c USING (h0, h1) WHERE c.h0 IS NOT NULL OR sid IN (0, 1)".replace("pairs LEFT JOIN c USING (h0, h1)", "pairs p LEFT JOIN c ON p.h0 = c.h0 AND p.h1 = c.h1").replace("SELECT h0, h1, sid", "SELECT p.h0, p.h1, sid"))
def supported_pairs(spark, base):
    return P.supported(C.pairs(spark, base), 3, [0, 1])


@query(f"WITH {_PAIRS}, a AS (SELECT h0, h1, count(*) AS c0 FROM pairs WHERE sid % 2 = 0 GROUP BY h0, h1), b AS (SELECT h0, h1, count(*) AS c1 FROM pairs WHERE sid % 2 = 1 GROUP BY h0, h1) SELECT sid, bgn, end_pos, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1, (coalesce(c0, 0) + 0.0001::DOUBLE) / (coalesce(c1, 0) + 0.0001::DOUBLE) AS ratio FROM pairs LEFT JOIN a USING (h0, h1) LEFT JOIN b USING (h0, h1)")
def coverage_ratio(spark, base):
    pairs = C.pairs(spark, base)
    return P.coverage_ratio(pairs, pairs.where("sid % 2 = 0"), pairs.where("sid % 2 = 1"))


@query(f"WITH {_PAIRS}, c AS (SELECT h0, h1, count(*) FILTER (WHERE sid % 2 = 0) AS c0, count(*) FILTER (WHERE sid % 3 = 0) AS c1 FROM pairs GROUP BY h0, h1) SELECT sid, bgn, end_pos, c0, c1 FROM pairs JOIN c USING (h0, h1)")
def coverage_by_sample_set(spark, base):
    pairs = C.pairs(spark, base)
    return P.coverage_by_sets(pairs, pairs, F.col("sid") % 2 == 0, F.col("sid") % 3 == 0)


@query(f"WITH {_PAIRS}, a AS (SELECT h0, h1, count(*) FILTER (WHERE sid % 2 = 0) AS c0, count(*) FILTER (WHERE sid % 2 = 1) AS c1 FROM pairs GROUP BY h0, h1), k AS (SELECT sid, bgn, end_pos FROM pairs JOIN a USING (h0, h1) WHERE (c0 + 0.0001) / (c1 + 0.0001) > 2), l AS (SELECT *, lag(end_pos) OVER (PARTITION BY sid ORDER BY bgn, end_pos) AS p FROM k), g AS (SELECT *, sum(CASE WHEN p IS NULL OR bgn - p >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY bgn, end_pos ROWS UNBOUNDED PRECEDING) AS i FROM l) SELECT sid, min(bgn) AS bgn, max(end_pos) AS end_pos, count(*) AS n FROM g GROUP BY sid, i HAVING max(end_pos) - min(bgn) > 100")
def coverage_outliers(spark, base):
    pairs = C.pairs(spark, base)
    ratio = P.coverage_ratio(pairs, pairs.where("sid % 2 = 0"), pairs.where("sid % 2 = 1"))
    return V.outlier_regions(ratio, ["sid"], F.col("ratio") > 2, 200, 100)


@query(f"WITH {_MARKS}, f AS (SELECT DISTINCT hash FROM marks WHERE sid % 50 = 0) SELECT sid, count(*) AS n, CAST(count(*) FILTER (WHERE hash IN (SELECT hash FROM f)) AS BIGINT) AS found FROM marks GROUP BY sid HAVING count(*) FILTER (WHERE hash IN (SELECT hash FROM f)) > 0.8 * count(*)")
def read_filter(spark, base):
    m = C.marks(spark, base)
    return P.contained(m, m.where("sid % 50 = 0"), 0.8)


@query(f"WITH {_MARKS}, a AS (SELECT hash, count(*) AS in_target FROM marks WHERE sid % 3 = 0 GROUP BY hash), b AS (SELECT hash, count(*) AS in_reference FROM marks WHERE sid % 3 = 1 GROUP BY hash), c AS (SELECT hash, count(*) AS in_reads FROM marks WHERE sid % 3 = 2 GROUP BY hash) SELECT sid, pos, hash, in_target, in_reference, in_reads FROM marks JOIN a USING (hash) JOIN b USING (hash) JOIN c USING (hash) WHERE sid % 3 = 0")
def mark_counts(spark, base):
    m = C.marks(spark, base)
    return P.mark_counts(m.where("sid % 3 = 0"), m.where("sid % 3 = 1"), m.where("sid % 3 = 2"))


@query(f"WITH {_SEQS}, p AS (SELECT DISTINCT sid AS probe_sid, upper(substr(seq, 201, 40)) AS probe FROM seqs WHERE sid % 50 = 0 AND length(seq) >= 240) SELECT probe_sid, sid FROM p JOIN seqs ON contains(upper(seq), probe)")
def probe_match(spark, base):
    """Exact containment of probes of one length, by an equi-join with the k-mers of that length."""
    seqs = C.sequences(spark, base)
    probes = seqs.where("sid % 50 = 0 AND length(seq) >= 240").select(F.col("sid").alias("probe_sid"), F.upper(F.substring("seq", 201, 40)).alias("kmer"))
    return seqs.select("sid", F.explode(dna.kmers(F.upper("seq"), 40)).alias("kmer")).join(probes, "kmer").select("probe_sid", "sid").distinct()


@query(f"WITH {_SEQS}, k AS (SELECT DISTINCT sid, substr(upper(seq), CAST(i AS INTEGER), 31) AS kmer FROM seqs, LATERAL (SELECT unnest(range(1, length(seqs.seq) - 29)) AS i)), r AS (SELECT sid, kmer FROM k WHERE sid % 50 = 0 UNION SELECT sid, reverse(translate(kmer, 'ACGT', 'TGCA')) FROM k WHERE sid % 50 = 0) SELECT r.sid AS ref_sid, k.sid, count(*) AS n FROM r JOIN k USING (kmer) GROUP BY r.sid, k.sid HAVING count(*) >= 4")
def multi_filter(spark, base):
    """Reads that share k-mers with a reference on either strand."""
    seqs = C.sequences(spark, base).select("sid", F.upper("seq").alias("seq"))
    own = seqs.where("sid % 50 = 0")
    references = stored(N.distinct_kmers(own.union(own.select("sid", dna.reverse_complement("seq"))), 31))
    return P.shared_kmers(references, N.distinct_kmers(seqs, 31, N.kmer_filter(references)), 4)


# ------------------------------------------------------------------ graph

_EDGES = """o AS (SELECT sid, end_pos, h0, h1, orientation AS ori, ok, lead(bgn) OVER w AS nb, lead(h0) OVER w AS n0, lead(h1) OVER w AS n1, lead(orientation) OVER w AS no, lead(ok) OVER w AS nok FROM src WINDOW w AS (PARTITION BY sid ORDER BY bgn, end_pos, h0, h1, orientation)),
l AS (SELECT * FROM o WHERE ok AND nok AND end_pos = nb),
e AS (SELECT sid, h0 AS v_h0, h1 AS v_h1, ori AS v_ori, n0 AS w_h0, n1 AS w_h1, no AS w_ori FROM l UNION ALL SELECT sid, n0, n1, 1 - no, h0, h1, 1 - ori FROM l)"""
_ALL_EDGES = f"{_PAIRS}, src AS (SELECT *, true AS ok FROM pairs), {_EDGES}"


@query(f"WITH {_ALL_EDGES} SELECT * FROM e")
def adj_list(spark, base):
    return P.edges(C.pairs(spark, base))


@query(f"WITH {_PAIRS}, c AS (SELECT h0, h1 FROM pairs GROUP BY h0, h1 HAVING count(*) >= 3), src AS (SELECT p.*, (c.h0 IS NOT NULL) OR sid IN (0, 1) AS ok FROM pairs p LEFT JOIN c USING (h0, h1)), {_EDGES} SELECT * FROM e")
def adj_list_min_cov(spark, base):
    return P.edges(C.pairs(spark, base), 3, [0, 1])


@query(f"WITH {_PAIRS} SELECT h0, h1, CAST(sum(end_pos - bgn) // count(*) + 56 AS BIGINT) AS length, count(*) AS n FROM pairs GROUP BY h0, h1")
def gfa_segments(spark, base):
    return P.segments(C.pairs(spark, base), 56)


@query(f"WITH {_ALL_EDGES} SELECT v_h0, v_h1, v_ori, w_h0, w_h1, w_ori, count(*) AS n FROM e WHERE v_h0 <= w_h0 GROUP BY ALL")
def gfa_links(spark, base):
    return P.gfa_links(P.edges(C.pairs(spark, base)))


# ------------------------------------------------------------------ intervals

_REACH = "max(end_pos) OVER (PARTITION BY ctg, b_direction ORDER BY bgn, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {_BED}, r AS (SELECT *, {_REACH} AS reach FROM bed), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR bgn - reach >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY ctg, b_direction ORDER BY bgn, end_pos ROWS UNBOUNDED PRECEDING) AS i FROM r) SELECT ctg, b_direction, min(bgn) AS bgn, max(end_pos) AS end_pos, max(end_pos) - min(bgn) AS length, count(*) AS n FROM g GROUP BY ctg, b_direction, i")
def merge_regions(spark, base):
    return V.merge_regions(C.stretches(spark, base), ["ctg", "b_direction"], 50)


@query(f"WITH {_BED}, r0 AS (SELECT *, {_REACH} AS reach FROM bed), r AS (SELECT * FROM r0 WHERE reach IS NULL OR end_pos > reach), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR bgn - reach >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY ctg, b_direction ORDER BY bgn, end_pos ROWS UNBOUNDED PRECEDING) AS i FROM r) SELECT ctg, b_direction, min(bgn) AS bgn, max(end_pos) AS end_pos, CAST(sum(end_pos - bgn) AS BIGINT) AS length, count(*) AS n FROM g GROUP BY ctg, b_direction, i")
def merge_regions_summed(spark, base):
    return V.merge_regions_summed(C.stretches(spark, base), ["ctg", "b_direction"], 50)


def _bed_intervals(spark, base):
    return C.stretches(spark, base).select("bed_id", F.col("ctg").alias("chr"), "bgn", "end_pos")


@query(f"WITH {_BED}, {_GFF} SELECT bed_id, rec_id FROM bed JOIN gff ON ctg = chr AND bgn < gff.b_end AND gff.b_bgn < end_pos")
def interval_overlap(spark, base):
    return V.overlap_join(_bed_intervals(spark, base), C.features(spark, base)).select("bed_id", "rec_id")


@query(f"WITH {_BED}, {_GFF} SELECT DISTINCT bed_id FROM bed JOIN gff ON ctg = chr AND bgn < gff.b_end AND gff.b_bgn < end_pos")
def interval_semi(spark, base):
    return V.overlap_join(_bed_intervals(spark, base), C.features(spark, base), "semi").select("bed_id")


@query(f"WITH {_BED}, {_GFF} SELECT bed_id FROM bed WHERE NOT EXISTS (SELECT 1 FROM gff WHERE ctg = chr AND bgn < b_end AND b_bgn < end_pos)")
def interval_anti(spark, base):
    return V.overlap_join(_bed_intervals(spark, base), C.features(spark, base), "anti").select("bed_id")


@query(f"WITH {_BED}, {_GFF} SELECT rec_id, bed_id FROM gff JOIN bed ON ctg = chr AND gff.b_bgn >= bgn AND gff.b_bgn < end_pos")
def point_in_interval(spark, base):
    points = C.features(spark, base).select("rec_id", "chr", F.col("b_bgn").alias("pos"))
    bed = _bed_intervals(spark, base).select("bed_id", "chr", F.col("bgn").alias("b_bgn"), F.col("end_pos").alias("b_end"))
    return V.point_join(points, bed).select("rec_id", "bed_id")


@query(f"WITH {_BED}, {_GFF} SELECT bed_id, string_agg(DISTINCT name, '/' ORDER BY name) AS genes FROM bed JOIN gff ON ctg = chr AND bgn < gff.b_end AND gff.b_bgn < end_pos WHERE name <> '' GROUP BY bed_id")
def annotate_genes(spark, base):
    met = V.overlap_join(_bed_intervals(spark, base), C.features(spark, base).where("name <> ''"))
    return V.joined_names(met, ["bed_id"], "name", "genes")


@query(f"""WITH {_BED}, r AS (SELECT ctg, bgn, end_pos, bed_id, greatest(coalesce(max(end_pos) OVER (PARTITION BY ctg ORDER BY bgn, end_pos DESC, bed_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS reach FROM bed)
SELECT ctg, 'G' AS kind, reach AS bgn, bgn AS end_pos, bed_id FROM r WHERE bgn > reach UNION ALL SELECT ctg, 'D', bgn, end_pos, bed_id FROM r WHERE bgn <= reach AND end_pos <= reach UNION ALL SELECT ctg, 'O', bgn, reach, bed_id FROM r WHERE bgn <= reach AND end_pos > reach
UNION ALL SELECT ctg, 'G', greatest(max(end_pos), 0), any_value(len), NULL FROM bed JOIN (SELECT DISTINCT name, length(seq) AS len FROM sequences) ON name = ctg GROUP BY ctg""")
def tiling_target(spark, base):
    lengths = C.sequences(spark, base).select(F.col("name").alias("ctg"), F.length("seq").alias("len"))
    return V.tiling(C.stretches(spark, base), "ctg", "bgn", "end_pos", "bed_id", lengths)


@query(f"WITH {_BED}, {_GFF}, p AS (SELECT DISTINCT chr, b_bgn AS pos FROM gff) SELECT chr, pos, CAST((SELECT max(bgn) FROM bed WHERE ctg = chr AND bgn < pos) AS BIGINT) AS left_bgn, CAST((SELECT min(end_pos) FROM bed WHERE ctg = chr AND end_pos > pos) AS BIGINT) AS right_end FROM p")
def bracket_positions(spark, base):
    anchors = C.stretches(spark, base).select(F.col("ctg").alias("chr"), F.col("bgn").alias("q_bgn"), F.col("end_pos").alias("q_end"))
    return V.brackets(C.features(spark, base).select("chr", F.col("b_bgn").alias("pos")), anchors, ["chr"])


_VARIANTS = f"{_BED}, v AS (SELECT ctg AS t_name, bgn AS ts, end_pos - bgn AS tl, CAST(b_size AS VARCHAR) AS t_str, CAST(bed_id AS VARCHAR) AS q_str FROM bed), l AS (SELECT *, lag(ts + tl) OVER (PARTITION BY t_name ORDER BY ts, tl, q_str) AS p FROM v), g AS (SELECT t_name, ts, tl, t_str, q_str, CAST(sum(CASE WHEN p IS NULL OR ts >= p THEN 1 ELSE 0 END) OVER (PARTITION BY t_name ORDER BY ts, tl, q_str ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM l)"


def _variants(spark, base):
    return C.stretches(spark, base).select(F.col("ctg").alias("t_name"), F.col("bgn").alias("ts"), (F.col("end_pos") - F.col("bgn")).alias("tl"), F.col("b_size").cast("string").alias("t_str"), F.col("bed_id").cast("string").alias("q_str"))


@query(f"WITH {_VARIANTS} SELECT * FROM g")
def variant_groups(spark, base):
    return V.variant_groups(_variants(spark, base))


@query(f"WITH {_VARIANTS}, r AS (SELECT *, row_number() OVER (PARTITION BY t_name, grp ORDER BY ts, tl, q_str) AS row FROM g), s AS (SELECT *, min(row) OVER (PARTITION BY t_name, grp, ts, t_str, q_str) AS seen FROM r) SELECT t_name, ts, tl, t_str, q_str, grp, CAST(dense_rank() OVER (PARTITION BY t_name, grp ORDER BY seen) AS INTEGER) AS allele FROM s")
def allele_numbers(spark, base):
    return V.allele_numbers(V.variant_groups(_variants(spark, base)))


# ------------------------------------------------------------------ bundles


@query(f"WITH {_BED} SELECT bed_id, ctg, b_id, CASE WHEN count(*) OVER (PARTITION BY ctg, b_id) > 1 THEN 'R' ELSE 'U' END AS flag FROM bed WHERE b_id IS NOT NULL")
def bundle_repeat_flag(spark, base):
    return B.repeat_flags(C.stretches(spark, base)).select("bed_id", "ctg", "b_id", "flag")


_FLAGGED = f"{_BED}, f AS (SELECT ctg, CAST(end_pos - bgn AS BIGINT) AS s, CASE WHEN count(*) OVER (PARTITION BY ctg, b_id) > 1 THEN 'R' ELSE 'U' END AS flag FROM bed WHERE b_id IS NOT NULL)"
_PARTS = ", ".join(f"{fn}(s) FILTER (WHERE flag = '{f}') AS {name}_{what}" for f, name in (("R", "repeat"), ("U", "unique")) for what, fn in (("count", "count"), ("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")))


@query(f"WITH {_FLAGGED} SELECT ctg, count(*) AS n, sum(s) AS total, {_PARTS}, 100.0::DOUBLE * coalesce(sum(s) FILTER (WHERE flag = 'R'), 0) / sum(s) AS repeat_percent FROM f GROUP BY ctg")
def bundle_summary(spark, base):
    return B.contig_summary(B.repeat_flags(C.stretches(spark, base)))


@query(f"""WITH {_BED}, f AS (SELECT ctg, b_id, b_direction AS d, CAST(abs(CAST(end_pos AS BIGINT) - bgn) AS BIGINT) AS s FROM bed WHERE abs(b_bgn - b_end) > b_size * 0.5), k AS (SELECT b_id, d, row_number() OVER (ORDER BY avg(s) DESC, b_id, d) AS rank FROM f GROUP BY b_id, d),
c AS (SELECT ctg, rank, count(*) AS n FROM f JOIN k USING (b_id, d) GROUP BY ctg, rank), v AS (SELECT ctg, list(coalesce(n, 0) ORDER BY rank) AS counts FROM (SELECT DISTINCT ctg FROM bed), k LEFT JOIN c USING (ctg, rank) GROUP BY ctg)
SELECT row_number() OVER (ORDER BY counts DESC, ctg DESC) - 1 AS ord, ctg, array_to_string(counts, ',') AS counts FROM v""".replace("(SELECT DISTINCT ctg FROM bed), k LEFT JOIN", "(SELECT * FROM (SELECT DISTINCT ctg FROM bed), k) LEFT JOIN"))
def bundle_sorted(spark, base):
    return B.bundle_count_order(C.stretches(spark, base)).select("ord", "ctg", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


_RUNS = f"""{_BED}, p AS (SELECT ctg AS sid, row_number() OVER (PARTITION BY ctg ORDER BY bgn, end_pos, bed_id) AS ord, bgn, end_pos, b_id, b_direction AS d, b_bgn AS pos FROM bed WHERE b_id IS NOT NULL),
c AS (SELECT *, CASE WHEN lag(b_id) OVER w IS NULL OR lag(b_id) OVER w <> b_id OR lag(d) OVER w <> d THEN 1 ELSE 0 END AS f FROM p WINDOW w AS (PARTITION BY sid ORDER BY ord)),
r AS (SELECT *, sum(f) OVER (PARTITION BY sid ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (SELECT sid, run, b_id, d, min(bgn) AS bgn, max(end_pos) AS end_pos, count(*) AS n, arg_min(pos, ord) AS v_bgn, arg_max(pos, ord) AS v_end FROM r GROUP BY sid, run, b_id, d HAVING max(end_pos) - min(bgn) > 50),
a AS (SELECT *, CASE WHEN lag(end_pos) OVER w IS NULL OR lag(b_id) OVER w <> b_id OR lag(d) OVER w <> d OR abs(bgn - lag(end_pos) OVER w) >= 100 THEN 1 ELSE 0 END AS f FROM k WINDOW w AS (PARTITION BY sid ORDER BY run)),
g AS (SELECT *, sum(f) OVER (PARTITION BY sid ORDER BY run ROWS UNBOUNDED PRECEDING) AS g FROM a)"""


@query(f"WITH {_RUNS} SELECT sid, min(bgn) AS bgn, max(end_pos) AS end_pos, b_id AS bundle_id, d AS dir, CAST(sum(n) AS BIGINT) AS n, arg_min(v_bgn, run) AS v_bgn, arg_max(v_end, run) AS v_end FROM g GROUP BY sid, g, b_id, d")
def bundle_runs(spark, base):
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("ctg").orderBy("bgn", "end_pos", "bed_id"))
    placed = C.stretches(spark, base).where("b_id IS NOT NULL").select(F.col("ctg").alias("sid"), order.alias("ord"), "bgn", "end_pos", F.col("b_id").alias("bundle_id"), F.col("b_direction").alias("direction"), F.lit(0).alias("orientation"), F.col("b_bgn").alias("pos"))
    return B.bundle_runs(placed, 50, 100)


# the annotated stretches stand in for the ranges of chains: query = bundle, target = contig, orientation = direction

_RANGES = f"{_BED}, rg AS (SELECT b_id AS q_sid, ctg AS sid, b_direction AS orientation, bed_id AS chain, b_size AS n, bgn, end_pos, least(b_bgn, b_end) AS q_bgn, greatest(b_bgn, b_end) AS q_end FROM bed WHERE b_id IS NOT NULL)"


def _ranges(spark, base):
    bed = C.stretches(spark, base).where("b_id IS NOT NULL")
    return bed.select(F.col("b_id").alias("q_sid"), F.col("ctg").alias("sid"), F.col("b_direction").alias("orientation"), F.col("bed_id").alias("chain"), F.col("b_size").alias("n"), "bgn", "end_pos", F.least("b_bgn", "b_end").alias("q_bgn"), F.greatest("b_bgn", "b_end").alias("q_end"))


@query(f"WITH {_RANGES}, r AS (SELECT *, max(end_pos) OVER (PARTITION BY q_sid, sid, orientation ORDER BY bgn, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR bgn - reach >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY q_sid, sid, orientation ORDER BY bgn, end_pos ROWS UNBOUNDED PRECEDING) AS i FROM r) SELECT q_sid, sid, orientation, min(bgn) AS bgn, max(end_pos) AS end_pos, max(end_pos) - min(bgn) AS length, count(*) AS n, CAST(sum(n) AS BIGINT) AS anchors, min(q_bgn) AS q_bgn, max(q_end) AS q_end FROM g GROUP BY q_sid, sid, orientation, i".replace("count(*) AS n, CAST(sum(n)", "count(*) AS n, CAST(sum(g.n)"))
def hit_regions(spark, base):
    return H.query_regions(_ranges(spark, base), 200)


@query(f"WITH {_RANGES}, s AS (SELECT q_sid, sid, min(q_bgn) AS q_bgn, max(q_end) AS q_end, min(bgn) AS bgn, max(end_pos) AS end_pos, CAST(sum(n) AS BIGINT) AS n_hits, max(orientation) AS reversed FROM rg GROUP BY q_sid, sid) SELECT * FROM s WHERE n_hits > 10 AND end_pos - bgn > 0.6 * (q_end - q_bgn)")
def hit_strong(spark, base):
    return H.strong_hits(H.hit_summary(_ranges(spark, base)), 10, 0.6)


@query(f"WITH {_RANGES} SELECT q_sid, sid, q_bgn, q_end FROM (SELECT sid AS q_sid, q_sid AS sid, bgn AS q_bgn, end_pos AS q_end, row_number() OVER (PARTITION BY sid ORDER BY end_pos - bgn DESC, q_sid, bgn) AS k FROM rg) WHERE k = 1")
def hit_largest(spark, base):
    r = _ranges(spark, base)
    return H.largest_block(r.select(F.col("sid").alias("q_sid"), F.col("q_sid").alias("sid"), F.col("bgn").alias("q_bgn"), F.col("end_pos").alias("q_end")))


# pairs stand in for the vertices of bundles: a hundred bundles by the first hash

_GIVEN = f"{_PAIRS}, given AS (SELECT DISTINCT CAST(h0 % 100 AS BIGINT) AS bundle_id, CAST(h1 % 1000 AS BIGINT) AS pos, h0, h1, CAST((h0 + h1) % 2 AS INTEGER) AS ori FROM pairs WHERE h0 % 3 = 0)"
_PLACED = f"{_GIVEN}, placed AS (SELECT sid, ord, bgn, end_pos, orientation, p.h0, p.h1, bundle_id, ori AS direction, pos FROM pairs p LEFT JOIN given g ON p.h0 = g.h0 AND p.h1 = g.h1)"


def _given(spark, base):
    pairs = C.pairs(spark, base)
    h0, h1 = F.col("h0"), F.col("h1")
    return pairs, pairs.where("h0 % 3 = 0").select((h0 % 100).alias("bundle_id"), (h1 % 1000).alias("pos"), "h0", "h1", ((h0 % 2 + h1 % 2) % 2).cast("int").alias("ori")).distinct()


@query(f"WITH {_PLACED} SELECT * FROM placed")
def decomposition_given(spark, base):
    pairs, bundles = _given(spark, base)
    return B.decompose(pairs, B.vertex_map(bundles))


@query(f"WITH {_PLACED}, f AS (SELECT bundle_id, sid, min(ord) AS o, sum(CAST(direction <> orientation AS INTEGER)) AS d, count(*) AS n FROM placed WHERE bundle_id IS NOT NULL GROUP BY bundle_id, sid) SELECT bundle_id, CAST(floor(avg(o)) AS BIGINT) AS mean_order, CAST(NOT (sum(d) < sum(n) // 2) AS INTEGER) AS turned FROM f GROUP BY bundle_id")
def bundle_votes_given(spark, base):
    pairs, bundles = _given(spark, base)
    return B.bundle_votes(B.decompose(pairs, B.vertex_map(bundles)))


@query(f"WITH {_BED}, t AS (SELECT ctg, b_id, sum(end_pos - bgn) AS total FROM bed WHERE b_id IS NOT NULL GROUP BY ctg, b_id) SELECT ctg AS q_sid, arg_max(b_id, total * 1000000 - b_id) AS sid, CAST(max(total) AS BIGINT) AS total FROM t GROUP BY ctg")
def best_target(spark, base):
    from strandframe.operators.chains import best_target as best

    rows = C.stretches(spark, base).where("b_id IS NOT NULL").select(F.col("ctg").alias("q_sid"), F.col("b_id").alias("sid"), F.col("bgn").alias("q_bgn"), F.col("end_pos").alias("q_end"))
    return best(rows)
