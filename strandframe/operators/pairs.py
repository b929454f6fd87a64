"""Relational operators on the flat table of pairs (sid, ord, h0, h1, bgn, end_pos, orientation).

The table stays flat: counts are taken by key where they are wanted, so a repeat with millions of places costs rows
and never one huge value. Operators that only count do so before they join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.session import stored

KEY = ["h0", "h1"]


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(h0, h1, n): number of places of each pair."""
    return pairs.groupBy(*KEY).agg(F.count("*").alias("n"))


def pair_count(pairs: DataFrame, h0: int, h1: int) -> DataFrame:
    """(n): number of places of one pair; the filter reaches the scan."""
    return pairs.where((F.col("h0") == h0) & (F.col("h1") == h1)).agg(F.count("*").alias("n"))


def pair_source_counts(pairs: DataFrame, catalog: DataFrame, max_unique: int | None = None) -> DataFrame:
    """(h0, h1, source, n): places by source, optionally only of the pairs with fewer than ``max_unique`` of them.

    Counts are taken by sid first, so the join with the catalog (sid, source) sees one row per pair and sequence.
    """
    by_sid = pairs.groupBy(*KEY, "sid").agg(F.count("*").alias("n"))
    out = by_sid.join(catalog.select("sid", "source"), "sid").groupBy(*KEY, "source").agg(F.sum("n").alias("n"))
    return out if max_unique is None else out.where(F.col("n") < max_unique)


def pair_unique_sources(pairs: DataFrame, catalog: DataFrame, most: int) -> DataFrame:
    """(h0, h1, n_sources): number of sources in which a pair has at most ``most`` places."""
    return pair_source_counts(pairs, catalog).where(F.col("n") <= most).groupBy(*KEY).agg(F.count("*").alias("n_sources"))


def frequent_pairs(pairs: DataFrame, least: int) -> DataFrame:
    return pair_counts(pairs).where(F.col("n") >= least)


def postings(pairs: DataFrame, h0: int | None = None, h1: int | None = None) -> DataFrame:
    """The places (sid, bgn, end_pos, orientation) of all pairs, or of one."""
    out = pairs if h0 is None else pairs.where((F.col("h0") == h0) & (F.col("h1") == h1))
    return out.select(*KEY, "sid", "bgn", "end_pos", "orientation")


def supported(pairs: DataFrame, least: int, keeps: list[int] | None = None) -> DataFrame:
    """The places of pairs with at least ``least`` places, and all places of the sequences in ``keeps``.

    The counts are joined back, so a frequent pair is counted on the map side instead of being gathered in a window.
    """
    enough = frequent_pairs(pairs, least).select(*KEY, F.lit(True).alias("enough"))
    keep = F.col("enough").isNotNull() | (F.col("sid").isin(keeps) if keeps else F.lit(False))
    return pairs.join(enough, KEY, "left").where(keep).drop("enough")


#: Hits that one share of a repeat's places gives, and most shuffle partitions of a join of hits.
SHARE, MOST_PARTS = 500_000, 4096


def hits(query: DataFrame, index: DataFrame) -> DataFrame:
    """Places of each query pair in the index; query pairs without any keep a row of nulls. Query columns are prefixed q_.

    The places of a repeat are dealt out to shares, each of which meets all of its query places in a partition of its own; a
    pair of a repeat gives the product of both, which one task can't do. The partitions are as many as the hits need.
    """
    spark = query.sparkSession
    q = stored(query.select(*KEY, F.col("sid").alias("q_sid"), F.col("bgn").alias("q_bgn"), F.col("end_pos").alias("q_end"), F.col("orientation").alias("q_orientation")))
    asked = q.groupBy(*KEY).agg(F.count("*").alias("asked"))
    places = stored(index.select(*KEY, "sid", "bgn", "end_pos", "orientation").join(asked.select(*KEY), KEY, "left_semi"))
    found = F.col("asked").cast("double") * F.col("held")
    weighed = asked.join(places.groupBy(*KEY).agg(F.count("*").alias("held")), KEY)
    repeats = stored(weighed.select(*KEY, F.least(F.ceil(found / SHARE), "held").cast("int").alias("shares"), found.alias("hits")))
    whole = repeats.agg(F.sum("hits")).first()[0] or 0
    parts = int(min(MOST_PARTS, max(spark.sparkContext.defaultParallelism, -(-whole // (4 * SHARE)))))
    repeats = repeats.where("shares > 1").select(*KEY, "shares")
    one = F.coalesce("shares", F.lit(1))
    deal = F.pmod(F.xxhash64("sid", "bgn", "end_pos", "orientation"), one).cast("int")
    left = q.join(repeats, KEY, "left").withColumn("share", F.explode(F.sequence(F.lit(0), one - 1))).repartition(parts, *KEY, "share")
    right = places.join(repeats, KEY, "left").withColumn("share", deal).drop("shares").withColumn("there", F.lit(True)).repartition(parts, *KEY, "share")
    # a share without a place isn't a query pair without any
    met = left.join(right, [*KEY, "share"], "left").where("there OR shares IS NULL")
    return met.select(*KEY, "q_sid", "q_bgn", "q_end", "q_orientation", "sid", "bgn", "end_pos", "orientation")


def hit_counts(query: DataFrame, index: DataFrame) -> DataFrame:
    """(q_sid, q_bgn, q_end, h0, h1, n): number of places of each query pair in the index, 0 for none."""
    q = query.select(*KEY, F.col("sid").alias("q_sid"), F.col("bgn").alias("q_bgn"), F.col("end_pos").alias("q_end"))
    return q.join(pair_counts(index), KEY, "left").select("q_sid", "q_bgn", "q_end", *KEY, F.coalesce("n", F.lit(0)).alias("n"))


def suppressed_hits(query: DataFrame, index: DataFrame, max_count: int = 128, max_query: int = 128, max_target: int = 128, by: str = "q_sid") -> DataFrame:
    """Hits (q_sid, sid, q_bgn, q_end, q_orientation, bgn, end_pos, orientation) of pairs that aren't repeats.

    A pair counts only if the index has at most ``max_count`` and ``max_query`` places of it in all, and at most
    ``max_target`` in the target sequence. Both limits are applied to counts before the join, so repeats never meet.
    """
    q = query.select(*KEY, F.col("sid").alias("q_sid"), F.col("bgn").alias("q_bgn"), F.col("end_pos").alias("q_end"), F.col("orientation").alias("q_orientation"))
    asked = q.select(*KEY).distinct()
    own = index.join(asked, KEY, "left_semi")
    by_sid = own.groupBy(*KEY, "sid").agg(F.count("*").alias("in_target"))
    whole = by_sid.groupBy(*KEY).agg(F.sum("in_target").alias("in_all")).where(F.col("in_all") <= min(max_count, max_query))
    allowed = by_sid.where(F.col("in_target") <= max_target).join(whole, KEY).select(*KEY, "sid")
    places = own.join(allowed, [*KEY, "sid"], "left_semi").select(*KEY, "sid", "bgn", "end_pos", "orientation")
    return q.join(places, KEY).select("q_sid", "sid", "q_bgn", "q_end", "q_orientation", "bgn", "end_pos", "orientation")


def match_positions(query: DataFrame, index: DataFrame) -> DataFrame:
    """(q_sid, sid, bgn, end_pos, relative): places in the index that match a query, with the relative orientation."""
    h = hits(query, index).where("sid IS NOT NULL")
    return h.select("q_sid", "sid", "bgn", "end_pos", F.when(F.col("orientation") == F.col("q_orientation"), 0).otherwise(1).alias("relative"))


def dots(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, x, y): positions at which two mark tables (by, hash, pos) have the same hash."""
    by = by or []
    return a.select(*by, "hash", F.col("pos").alias("x")).join(b.select(*by, "hash", F.col("pos").alias("y")), [*by, "hash"]).select(*by, "x", "y")


def coverage_ratio(pairs: DataFrame, first: DataFrame, second: DataFrame, eps: float = 1e-4) -> DataFrame:
    """(sid, bgn, end_pos, c0, c1, ratio): coverage of each place by two sample sets; ratio is (c0 + eps) / (c1 + eps)."""
    c0, c1 = pair_counts(first).withColumnRenamed("n", "c0"), pair_counts(second).withColumnRenamed("n", "c1")
    out = pairs.join(c0, KEY, "left").join(c1, KEY, "left")
    c0, c1 = F.coalesce("c0", F.lit(0)), F.coalesce("c1", F.lit(0))
    return out.select("sid", "bgn", "end_pos", c0.alias("c0"), c1.alias("c1"), ((c0 + eps) / (c1 + eps)).alias("ratio"))


def coverage_by_sets(reference: DataFrame, index: DataFrame, in0: Column, in1: Column) -> DataFrame:
    """(sid, bgn, end_pos, c0, c1): for each place of the reference, places of its pair in two sets of sequences.

    ``in0`` and ``in1`` are conditions on the index; the sets may overlap.
    """
    both = index.groupBy(*KEY).agg(F.count_if(in0).alias("c0"), F.count_if(in1).alias("c1"))
    return reference.join(both, KEY, "left").select("sid", "bgn", "end_pos", F.coalesce("c0", F.lit(0)).alias("c0"), F.coalesce("c1", F.lit(0)).alias("c1"))


def mark_counts(targets: DataFrame, reference: DataFrame, reads: DataFrame) -> DataFrame:
    """(sid, pos, hash, in_target, in_reference, in_reads): marks of the targets that the two others have as well, in order of place."""
    count = lambda df, name: df.groupBy("hash").agg(F.count("*").alias(name))
    common = count(targets, "in_target").join(count(reference, "in_reference"), "hash").join(count(reads, "in_reads"), "hash")
    return targets.select("sid", "pos", "hash").join(common, "hash").select("sid", "pos", "hash", "in_target", "in_reference", "in_reads").orderBy("sid", "pos", "hash")


def contained(reads: DataFrame, filter_marks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(sid, n, found): sequences of which more than ``threshold`` of the marks (sid, hash) are in a set of marks (hash)."""
    known = filter_marks.select("hash").distinct().withColumn("known", F.lit(1))
    by = reads.groupBy("sid", "hash").agg(F.count("*").alias("m")).join(known, "hash", "left")
    out = by.groupBy("sid").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("known") == 1, F.col("m")).otherwise(0)).alias("found"))
    return out.where(F.col("found") > threshold * F.col("n"))


def shared_kmers(references: DataFrame, reads: DataFrame, least: int = 4) -> DataFrame:
    """(ref_sid, sid, n): pairs of a reference and a read that share at least ``least`` distinct k-mers (sid, kmer).

    Both sides are reduced to distinct k-mers first. K-mers of many references and many reads still meet; suppress
    repeats in the input where that matters.
    """
    r = references.select(F.col("sid").alias("ref_sid"), "kmer").distinct()
    return r.join(reads.select("sid", "kmer").distinct(), "kmer").groupBy("ref_sid", "sid").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- graph of neighbouring pairs


def edges(pairs: DataFrame, least: int = 0, keeps: list[int] | None = None) -> DataFrame:
    """(sid, v_h0, v_h1, v_ori, w_h0, w_h1, w_ori): both directions of each link between adjoining pairs of a sequence.

    Two pairs adjoin if they follow each other in order of place and the first ends where the second begins; pairs
    without enough support break the chain.
    """
    order = Window.partitionBy("sid").orderBy("bgn", "end_pos", "h0", "h1", "orientation")
    ahead = lambda c: F.lead(c).over(order)
    if least > 1:
        enough = frequent_pairs(pairs, least).select(*KEY, F.lit(1).alias("enough"))
        marked = pairs.join(enough, KEY, "left").withColumn("ok", F.col("enough").isNotNull() | (F.col("sid").isin(keeps) if keeps else F.lit(False)))
    else:
        marked = pairs.withColumn("ok", F.lit(True))
    both = marked.select("sid", "end_pos", "ok", "h0", "h1", "orientation", *(ahead(c).alias(f"n_{c}") for c in ("bgn", "ok", "h0", "h1", "orientation")))
    both = both.where("ok AND n_ok AND end_pos = n_bgn")
    node = lambda h0, h1, o: F.struct(F.col(h0).alias("h0"), F.col(h1).alias("h1"), o.alias("ori"))
    v, w = ("h0", "h1", F.col("orientation")), ("n_h0", "n_h1", F.col("n_orientation"))
    turned = lambda x: node(x[0], x[1], 1 - x[2])
    link = F.explode(F.array(F.struct(node(*v).alias("v"), node(*w).alias("w")), F.struct(turned(w).alias("v"), turned(v).alias("w"))))
    return both.select("sid", link.alias("e")).select("sid", F.col("e.v.h0").alias("v_h0"), F.col("e.v.h1").alias("v_h1"), F.col("e.v.ori").alias("v_ori"), F.col("e.w.h0").alias("w_h0"), F.col("e.w.h1").alias("w_h1"), F.col("e.w.ori").alias("w_ori"))


def edge_support(links: DataFrame) -> DataFrame:
    """(v_h0, v_h1, v_ori, w_h0, w_h1, w_ori, n): number of times each directed link occurs."""
    return links.groupBy("v_h0", "v_h1", "v_ori", "w_h0", "w_h1", "w_ori").agg(F.count("*").alias("n"))


def segments(pairs: DataFrame, k: int) -> DataFrame:
    """(h0, h1, length, n): the vertices with the mean length of their places (whole bases) plus k."""
    length = F.expr("sum(CAST(end_pos AS BIGINT) - bgn) div count(*)") + k
    return pairs.groupBy(*KEY).agg(length.alias("length"), F.count("*").alias("n"))


def gfa_links(links: DataFrame) -> DataFrame:
    """The directed links of which the first vertex has the smaller or the same first hash, with their support."""
    return edge_support(links).where("v_h0 <= w_h0")
