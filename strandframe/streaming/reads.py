"""Streams of reads: records from growing folders, filtered against a fixed set and counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.operators.shimmers import ShimmerSpec, shimmers
from strandframe.sources.readers import fastq_records


def fasta_stream(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """(name, seq) of the FASTA files that appear in a folder."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_a_batch).text(folder)
    head = F.substring_index(F.regexp_replace("value", "^>", ""), "\n", 1)
    body = F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), "[\r\n>]", "")
    return raw.where("instr(value, '\n') > 0").select(F.regexp_extract(F.trim(head), r"^(\S*)", 1).alias("name"), body.alias("seq"))


def fastq_stream(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """(name, seq) of the FASTQ files that appear in a folder."""
    return fastq_records(spark.readStream.option("lineSep", "\n@").option("maxFilesPerTrigger", files_a_batch).text(folder))


def matching_reads(reads: DataFrame, known: DataFrame, spec: ShimmerSpec, threshold: float = 0.8):
    """A foreachBatch function's core: reads of a batch of which more than ``threshold`` of the marks are in ``known`` (hash).

    Works on a batch or a static table (name, seq); the join with the fixed set is planned by Catalyst, by its size.
    """
    marks = shimmers(reads, spec, key="name").withColumnRenamed("sid", "name")
    hit = marks.join(known.select("hash").distinct().withColumn("known", F.lit(1)), "hash", "left")
    kept = hit.groupBy("name").agg(F.count("*").alias("n"), F.count("known").alias("found")).where(F.col("found") > threshold * F.col("n"))
    return reads.join(kept.select("name"), "name", "left_semi")


def filter_stream(reads: DataFrame, known: DataFrame, spec: ShimmerSpec, sink: str, checkpoint: str, threshold: float = 0.8):
    """Writes the matching reads of each micro-batch to Parquet; a batch that is tried again overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        matching_reads(batch, known, spec, threshold).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def count_stream(reads: DataFrame, spec: ShimmerSpec) -> DataFrame:
    """(hash, n): running counts of marks, for a sink in update or complete mode."""
    return shimmers(reads, spec, key="name").groupBy("hash").agg(F.count("*").alias("n"))
