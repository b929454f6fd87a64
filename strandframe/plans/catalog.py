"""Tables of the engine as they are found in storage, cleaned once: sequences, catalog, marks and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.functions import dna
from strandframe.operators.shimmers import pair_marks
from strandframe.session import table


def sequences(spark: SparkSession, base: str) -> DataFrame:
    """(sid, name, source, seq), one row per sequence however often it was delivered."""
    return table(spark, base, "sequences", "sid", "name", "source", "seq").distinct()


def catalog(spark: SparkSession, base: str) -> DataFrame:
    """(sid, name, source): the sequences without their bases; sources in upper case without outer blanks."""
    return table(spark, base, "sequences", "sid", "name", "source").select("sid", "name", F.upper(F.trim("source")).alias("source")).distinct()


def marks(spark: SparkSession, base: str) -> DataFrame:
    """(sid, ord, hash, span, pos, strand) from the packed marks, without nulls, padding and repeated deliveries."""
    raw = table(spark, base, "shimmers", "sid", "ord", "x", "y").where("x IS NOT NULL AND NOT (x = -1 AND y <=> -1)").distinct()
    return raw.select("sid", "ord", dna.mark_hash("x").alias("hash"), dna.mark_span("x").alias("span"), dna.mark_pos("y").alias("pos"), dna.mark_strand("y").alias("strand"))


def pairs(spark: SparkSession, base: str, query: bool = False) -> DataFrame:
    return pair_marks(marks(spark, base), query)


def stretches(spark: SparkSession, base: str) -> DataFrame:
    """Valid rows of bundle_bed: contig without outer blanks, begin before end, each delivered row once."""
    bed = table(spark, base, "bundle_bed").drop("loaded_at").withColumn("ctg", F.trim("ctg")).distinct()
    return bed.where("ctg IS NOT NULL AND bgn IS NOT NULL AND end_pos IS NOT NULL AND bgn < end_pos")


def features(spark: SparkSession, base: str) -> DataFrame:
    """(rec_id, chr, type_name, b_bgn, b_end, name): annotation records as half-open intervals."""
    gff = table(spark, base, "gff_records", "rec_id", "seqid", "type_name", "bgn", "end_pos", "attributes").distinct()
    name = F.trim(F.regexp_extract("attributes", r'Name *[= ] *"?([^";,|]*)', 1))
    return gff.where("seqid IS NOT NULL AND bgn <= end_pos").select("rec_id", F.trim("seqid").alias("chr"), "type_name", (F.col("bgn") - 1).alias("b_bgn"), F.col("end_pos").alias("b_end"), name.alias("name"))
