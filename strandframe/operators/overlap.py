"""Interval joins, region merging and tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandframe.session import cut

BIN = 1 << 14


def _binned(df: DataFrame, bgn: str, end: str, width: int) -> DataFrame:
    """One row per bin that an interval touches; an empty interval touches the bin of its begin."""
    first = F.expr(f"floor({bgn} / {width})").cast("long")
    last = F.greatest(first, F.expr(f"floor(({end} - 1) / {width})").cast("long"))
    return df.withColumn("first_bin", first).withColumn("bin", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", width: int = BIN) -> DataFrame:
    """Pairs of rows of a (chr, bgn, end_pos, ...) and b (chr, b_bgn, b_end, ...) whose half-open intervals overlap.

    Both sides are cut into bins of ``width``, so the join is an equi-join on (chr, bin); a pair that meets in several
    bins is taken in the first of them. ``how`` 'semi' or 'anti' keeps the rows of a that have a partner or none.
    Null bounds never match, empty intervals neither.
    """
    met = _binned(a.where("bgn < end_pos"), "bgn", "end_pos", width).alias("a")
    other = _binned(b.where("b_bgn < b_end"), "b_bgn", "b_end", width).alias("b")
    exact = (F.col("a.chr") == F.col("b.chr")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.bgn") < F.col("b.b_end")) & (F.col("b.b_bgn") < F.col("a.end_pos"))
    own = [F.col(f"a.{c}") for c in a.columns]
    if how == "inner":
        once = F.col("a.bin") == F.greatest("a.first_bin", "b.first_bin")
        return met.join(other, exact & once).select(*own, *(F.col(f"b.{c}") for c in b.columns if c != "chr"))
    some = met.join(other, exact, "left_semi").select(*a.columns).distinct()
    if how == "semi":
        return some
    same = [a[c].eqNullSafe(some[c]) for c in a.columns]
    return a.join(some, same, "left_anti")


def point_join(points: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Rows of points (chr, pos, ...) with each interval of b (chr, b_bgn, b_end, ...) that holds the point."""
    met = points.withColumn("bin", F.expr(f"floor(pos / {width})").cast("long")).alias("a")
    other = _binned(b.where("b_bgn < b_end"), "b_bgn", "b_end", width).alias("b")
    inside = (F.col("a.chr") == F.col("b.chr")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.pos") >= F.col("b.b_bgn")) & (F.col("a.pos") < F.col("b.b_end"))
    return met.join(other, inside).select(*(F.col(f"a.{c}") for c in points.columns), *(F.col(f"b.{c}") for c in b.columns if c != "chr"))


def joined_names(df: DataFrame, by: list[str], name: str, out: str = "names") -> DataFrame:
    """The distinct names of each group, sorted and joined with a slash."""
    return df.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set(name)), "/").alias(out))


def merge_regions(df: DataFrame, by: list[str], tolerance: int, *more: Column) -> DataFrame:
    """(by, bgn, end_pos, length, n, more): regions whose gap to the furthest end before them is below ``tolerance`` are one.

    ``more`` are further aggregates over the merged rows.
    """
    w = Window.partitionBy(*by).orderBy("bgn", "end_pos")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("bgn") - reach >= tolerance), 1).otherwise(0)
    island = df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*by, "island").agg(F.min("bgn").alias("bgn"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n"), *more)
    rest = out.columns[len(by) + 4 :]
    return out.select(*by, "bgn", "end_pos", (F.col("end_pos") - F.col("bgn")).alias("length"), "n", *rest)


def merge_regions_summed(df: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """As merge_regions, but regions inside what came before are left out and length is the sum of the rest."""
    w = Window.partitionBy(*by).orderBy("bgn", "end_pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_pos").over(before)
    rows = df.withColumn("reach", reach).where("reach IS NULL OR end_pos > reach")
    fresh = F.when(F.col("reach").isNull() | (F.col("bgn") - F.col("reach") >= tolerance), 1).otherwise(0)
    island = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*by, "island").agg(F.min("bgn").alias("bgn"), F.max("end_pos").alias("end_pos"), F.sum(F.col("end_pos") - F.col("bgn")).alias("length"), F.count("*").alias("n"))
    return out.drop("island")


def outlier_regions(df: DataFrame, by: list[str], keep: Column, max_gap: int, min_span: int) -> DataFrame:
    """(by, bgn, end_pos, n): runs of places with ``keep`` whose gaps are below ``max_gap``, if they span more than ``min_span``."""
    w = Window.partitionBy(*by).orderBy("bgn", "end_pos")
    rows = df.where(keep)
    gap = F.col("bgn") - F.lag("end_pos").over(w)
    island = rows.withColumn("fresh", F.when(gap.isNull() | (gap >= max_gap), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*by, "island").agg(F.min("bgn").alias("bgn"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n"))
    return out.where(F.col("end_pos") - F.col("bgn") > min_span).drop("island")


def tiling(blocks: DataFrame, target: str = "t_name", bgn: str = "ts", end: str = "te", block: str = "block_id", lengths: DataFrame | None = None) -> DataFrame:
    """(target, kind, bgn, end_pos, block): how blocks lie along each target, as gaps G, duplicates D and overlaps O.

    In order of begin: a block that begins behind what is covered has a gap row before it, from the covered end (0 at first) to its
    begin; one that ends within what is covered is a duplicate, a row of its whole extent; any other, also one that begins exactly at
    the covered end, overlaps, a row from its begin to the covered end. With ``lengths`` (target, len) a gap row without a block leads
    from the last covered end to the target's length.
    """
    w = Window.partitionBy(target).orderBy(bgn, F.desc(end), block)
    reach = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.select(target, bgn, end, block).withColumn("reach", F.greatest(reach, F.lit(0)))
    kind = F.when(F.col(bgn) > F.col("reach"), "G").when(F.col(end) <= F.col("reach"), "D").otherwise("O")
    out = rows.withColumn("kind", kind)
    b = F.when(F.col("kind") == "G", F.col("reach")).otherwise(F.col(bgn))
    e = F.when(F.col("kind") == "G", F.col(bgn)).when(F.col("kind") == "D", F.col(end)).otherwise(F.col("reach"))
    out = out.select(target, "kind", b.alias("bgn"), e.alias("end_pos"), block)
    if lengths is None:
        return out
    last = blocks.groupBy(target).agg(F.greatest(F.max(end), F.lit(0)).alias("bgn")).join(lengths.select(target, "len"), target)
    return out.unionByName(last.select(target, F.lit("G").alias("kind"), "bgn", F.col("len").alias("end_pos"), F.lit(None).cast(blocks.schema[block].dataType).alias(block)))


def brackets(positions: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, left_bgn, right_end): per position the last anchor that begins before it and the first that ends behind it.

    Positions (by, pos) and anchors (by, q_bgn, q_end) are placed in one order per key and carried forward and back,
    which needs no join of each position with each anchor.
    """
    p = positions.select(*by, F.col("pos").alias("at"), F.lit(1).alias("is_pos"), F.lit(None).cast("long").alias("l"), F.lit(None).cast("long").alias("r")).distinct()
    left = anchors.select(*by, F.col("q_bgn").alias("at"), F.lit(2).alias("is_pos"), F.col("q_bgn").cast("long").alias("l"), F.lit(None).cast("long").alias("r"))
    right = anchors.select(*by, F.col("q_end").alias("at"), F.lit(0).alias("is_pos"), F.lit(None).cast("long").alias("l"), F.col("q_end").cast("long").alias("r"))
    w = Window.partitionBy(*by).orderBy("at", "is_pos")
    rows = p.unionByName(left).unionByName(right)
    rows = rows.withColumn("left_bgn", F.last("l", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("right_end", F.first("r", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return rows.where("is_pos = 1").select(*by, F.col("at").alias("pos"), "left_bgn", "right_end")


def variant_groups(variants: DataFrame, target: str = "t_name") -> DataFrame:
    """Adds ``grp``: variants (target, ts, tl, ...) in order; a new group begins at or behind the previous row's end."""
    w = Window.partitionBy(target).orderBy("ts", "tl", "q_str")
    fresh = F.when(F.lag(F.col("ts") + F.col("tl")).over(w).isNull() | (F.col("ts") >= F.lag(F.col("ts") + F.col("tl")).over(w)), 1).otherwise(0)
    return variants.withColumn("fresh", fresh).withColumn("grp", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def allele_numbers(grouped: DataFrame, target: str = "t_name") -> DataFrame:
    """Adds ``allele``: 1, 2, ... by the first appearance of each distinct change (ts, t_str, q_str) within a group."""
    order = Window.partitionBy(target, "grp").orderBy("ts", "tl", "q_str")
    change = Window.partitionBy(target, "grp", "ts", "t_str", "q_str")
    rows = grouped.withColumn("row", F.row_number().over(order)).withColumn("seen", F.min("row").over(change))
    return rows.withColumn("allele", F.dense_rank().over(Window.partitionBy(target, "grp").orderBy("seen"))).drop("row", "seen")


def layout_offsets(lengths: DataFrame, padding: int) -> DataFrame:
    """(name, length, offset): begins of items laid side by side from the longest to the shortest, with padding between.

    The items are range-sorted over all tasks; the driver adds up one sum a partition.
    """
    order = [F.desc("length"), F.col("name")]
    placed = cut(lengths.select("name", "length").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum(F.col("length") + padding).alias("n")).collect()}  # one row a partition
    begins, at = [], 0
    for part in sorted(sums):
        begins.append((part, at))
        at += sums[part]
    first = lengths.sparkSession.createDataFrame(begins, "part int, first long")
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("length") + padding).over(w), F.lit(0))
    return placed.join(F.broadcast(first), "part").select("name", "length", (F.col("first") + inside).alias("offset"))  # one row a partition
