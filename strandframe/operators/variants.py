"""From chains of a contig against a reference to alignment records, candidates and genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandframe.functions.dna import reverse_complement
from strandframe.operators import align as A, chains as H, overlap as V, pairs as P
from strandframe.operators.chains import forward_steps
from strandframe.operators.grouped import grouped_scan
from strandframe.session import stored

ENDS, SHORT, LONG_DIFF = 16, 16, 128


def unique_chains(query: DataFrame, reference: DataFrame, penalty: float = 0.025, max_gap: int = 100_000, max_span: int = 8) -> DataFrame:
    """Oriented chains over pairs that are unique in the reference, as assembly-to-reference alignment wants them."""
    return H.sparse_chains(P.suppressed_hits(query, reference, 1, 1, 1), max_span, penalty, max_gap, True)


def blocks(chains: DataFrame, k: int) -> DataFrame:
    """(q_sid, sid, chain, ord, ts, te, qs, qe, orientation, ctg_orientation): the steps along each chain of more than two anchors.

    The orientation of a chain, and of a contig on a target over all its chains, is that of the larger summed anchor length.
    Steps begin k earlier on both axes, so that they begin with a match; those that would begin before 0 are left out.
    """

    def work(key: tuple, rows: list[dict]):
        by: dict[int, list[tuple]] = {}
        for r in rows:
            by.setdefault(r["chain"], []).append((r["q_bgn"], r["q_end"], r["bgn"], r["end_pos"], r["q_orientation"] == r["orientation"]))
        by = {c: a for c, a in by.items() if len(a) > 2}
        weigh = lambda anchors: 0 if sum((e - b) * (1 if same else -1) for b, e, _, _, same in anchors) > 0 else 1
        whole = weigh([x for a in by.values() for x in a])
        for c, anchors in by.items():
            turn = weigh(anchors)
            for o, (ts, te, qs, qe) in enumerate(forward_steps(anchors, bool(turn))):
                if ts >= k and qs >= k and qs < qe:
                    yield (*key, c, o, ts - k, te, qs - k, qe, turn, whole)

    ids = ", ".join(f"{c} {chains.schema[c].dataType.simpleString()}" for c in ("q_sid", "sid"))
    return grouped_scan(chains.drop("score"), ["q_sid", "sid"], ["chain", "ord"], work, f"{ids}, chain int, ord int, ts int, te int, qs int, qe int, orientation int, ctg_orientation int")


def segment_class(t: str = "t_seq", q: str = "q_seq"):
    """S for short segments, L for lengths that differ too much, E for ends that differ, else null: worth an alignment."""
    a, b = F.col(t), F.col(q)
    return (
        F.when((F.length(a) <= SHORT) | (F.length(b) <= SHORT), "S")
        .when(F.abs(F.length(a) - F.length(b)) >= LONG_DIFF, "L")
        .when((F.substring(a, 1, ENDS) != F.substring(b, 1, ENDS)) | (F.right(a, F.lit(ENDS)) != F.right(b, F.lit(ENDS))), "E")
    )


def alignment_records(segments: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_sid, sid, chain, ord, ts, te, qs, qe, orientation, ctg_orientation, rec_type, diff_type, td, qd, vt, t_str, q_str).

    rec_type is M for a segment that matches, V for each variant in one, and S for a candidate with the reason in diff_type (S, L, E, or
    A if the alignment costs too much). Only segments that pass the cheap tests reach the aligner.
    """
    t = reference.select(F.col("sid"), F.col("seq").alias("t_all"))
    q = queries.select(F.col("sid").alias("q_sid"), F.col("seq").alias("q_all"))
    part = F.expr("substring(q_all, qs + 1, qe - qs)")
    seqs = segments.join(t, "sid").join(q, "q_sid").withColumn("t_seq", F.expr("substring(t_all, ts + 1, te - ts)")).withColumn("q_seq", F.when(F.col("orientation") == 0, part).otherwise(reverse_complement(part))).drop("t_all", "q_all")
    seqs = stored(seqs.withColumn("diff_type", segment_class()))  # read by two branches below, the alignments by three
    keys = ["q_sid", "sid", "chain", "ord", "ts", "te", "qs", "qe", "orientation", "ctg_orientation"]
    none = [F.lit(None).cast("int").alias("td"), F.lit(None).cast("int").alias("qd"), *(F.lit(None).cast("string").alias(c) for c in ("vt", "t_str", "q_str"))]
    out = stored(A.aligned(seqs.where("diff_type IS NULL").select(*keys, "t_seq", "q_seq")))
    same = out.where("cost = 0").select(*keys, F.lit("M").alias("rec_type"), F.lit(None).cast("string").alias("diff_type"), *none)
    failed = out.where("cost IS NULL").select(*keys, F.lit("S").alias("rec_type"), F.lit("A").alias("diff_type"), *none)
    found = A.variant_rows(out.where("cost > 0"), keys).select(*keys, F.lit("V").alias("rec_type"), F.lit(None).cast("string").alias("diff_type"), F.col("t_pos").alias("td"), F.col("q_pos").alias("qd"), F.col("kind").alias("vt"), "t_str", "q_str")
    quick = seqs.where("diff_type IS NOT NULL").select(*keys, F.lit("S").alias("rec_type"), "diff_type", *none)
    return same.unionByName(failed).unionByName(found).unionByName(quick)


def block_ends(segments: DataFrame) -> DataFrame:
    """(q_sid, sid, chain, ts, te, qs, qe, orientation): the whole extent of each block, as its begin and end records tell."""
    return segments.groupBy("q_sid", "sid", "chain").agg(*(f(c).alias(c) for f, c in ((F.min, "ts"), (F.max, "te"), (F.min, "qs"), (F.max, "qe"), (F.first, "orientation"))))


def tagged_records(records: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds t_dup, t_ovlp, q_dup and q_ovlp to records: whether their block is a duplicate or overlaps along the target and the query."""
    named = ends.withColumn("block_id", F.concat_ws("_", "q_sid", "sid", "chain"))
    flags = lambda by, b, e, p: V.tiling(named, by, b, e).where("kind IN ('D', 'O')").select("block_id", (F.col("kind") == "D").alias(f"{p}_dup"), (F.col("kind") == "O").alias(f"{p}_ovlp"))
    out = records.withColumn("block_id", F.concat_ws("_", "q_sid", "sid", "chain")).join(flags("sid", "ts", "te", "t"), "block_id", "left").join(flags("q_sid", "qs", "qe", "q"), "block_id", "left")
    for c in ("t_dup", "t_ovlp", "q_dup", "q_ovlp"):
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    return out


def genotypes(variants: DataFrame, covered: DataFrame) -> DataFrame:
    """(t_name, pos, ref, alt, gt): one row per group of overlapping variants of two haplotypes.

    ``variants`` has (t_name, ts, tl, hap 0 or 1, t_str, q_str); ``covered`` the aligned intervals (t_name, hap, b_bgn, b_end). Alleles are
    numbered by their first appearance in the group and spelled over the whole group; a haplotype without a variant is 0 where it is
    aligned and . elsewhere. pos counts from 1.
    """
    order = ["ts", "tl", "hap", "t_str", "q_str"]
    w = Window.partitionBy("t_name").orderBy(*order)
    fresh = F.when(F.lag(F.col("ts") + F.col("tl")).over(w).isNull() | (F.col("ts") >= F.lag(F.col("ts") + F.col("tl")).over(w)), 1).otherwise(0)
    g = variants.distinct().withColumn("fresh", fresh).withColumn("grp", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("t_name", "grp").orderBy(*order)
    g = g.withColumn("row", F.row_number().over(group)).withColumn("seen", F.min("row").over(Window.partitionBy("t_name", "grp", "ts", "t_str", "q_str"))).withColumn("allele", F.dense_rank().over(Window.partitionBy("t_name", "grp").orderBy("seen")))
    # the reference over a group: in order, each variant adds the letters behind what is known already
    rows = F.sort_array(F.collect_list(F.struct("row", "ts", "t_str", "q_str", "allele", "hap")))
    spelled = g.groupBy("t_name", "grp").agg(rows.alias("v"))
    start = F.struct(F.get("v", 0)["ts"].alias("bgn"), F.lit("").alias("ref"))
    known = lambda a: a["bgn"] + F.length(a["ref"])
    grow = lambda a, x: F.struct(a["bgn"].alias("bgn"), F.concat(a["ref"], F.when(x["ts"] + F.length(x["t_str"]) > known(a), F.substring(x["t_str"], known(a) - x["ts"] + 1, F.length(x["t_str"]))).otherwise("")).alias("ref"))
    spelled = spelled.withColumn("r", F.aggregate("v", start, grow)).withColumn("bgn", F.col("r.bgn")).withColumn("ref", F.col("r.ref"))
    alt = F.array_distinct(F.sort_array(F.transform("v", lambda x: F.struct(x["allele"].alias("a"), F.concat(F.substring(F.col("ref"), F.lit(1), x["ts"] - F.col("bgn")), x["q_str"], F.substring(F.col("ref"), x["ts"] - F.col("bgn") + F.length(x["t_str"]) + 1, F.length("ref"))).alias("s")))))
    out = spelled.withColumn("alt", F.array_join(F.transform(alt, lambda x: x["s"]), ","))
    last = lambda h: F.element_at(F.transform(F.filter("v", lambda x: x["hap"] == h), lambda x: x["allele"]), -1)
    has = lambda h: F.exists("v", lambda x: x["hap"] == h)
    out = out.select(F.col("t_name").alias("chr"), "grp", "bgn", (F.col("bgn") + F.length("ref")).alias("end_pos"), "ref", "alt", *(F.when(has(h), last(h)).alias(f"a{h}") for h in (0, 1)))
    for h in (0, 1):
        own = covered.where(F.col("hap") == h).select(F.col("t_name").alias("chr"), "b_bgn", "b_end")
        called = V.overlap_join(out.select("chr", "grp", "bgn", "end_pos"), own, "semi").select("chr", "grp", F.lit(True).alias(f"c{h}"))
        out = out.join(called, ["chr", "grp"], "left")
    gt = F.concat_ws("|", *(F.when(F.col(f"c{h}"), F.coalesce(F.col(f"a{h}").cast("string"), F.lit("0"))).otherwise(".") for h in (0, 1)))
    return out.select(F.col("chr").alias("t_name"), (F.col("bgn") + 1).alias("pos"), "ref", "alt", gt.alias("gt"))
