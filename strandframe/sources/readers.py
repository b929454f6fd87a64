"""Readers of the file formats, each as one scan of text; gzip is recognised by the file's ending.

Long records are cut by the reader's line or record separator, never by a regular expression over a whole file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from strandframe.functions.dna import attribute_map, last_attribute


def fasta(spark: SparkSession, path: str | list[str], source: str | None = None) -> DataFrame:
    """(name, source, seq): one row per record; the name ends at the first blank; line breaks inside the bases are dropped.

    Records are cut at a line break before '>'. ``source`` is the given one or the stem of the file's name.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    head, body = F.substring_index(record, "\n", 1), F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), "[\r\n>]", "")
    origin = F.lit(source) if source is not None else F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.(?:fa|fasta|fna))?(?:\.gz)?$", 1)
    return raw.where("instr(value, '\n') > 0").select(F.regexp_extract(F.trim(F.regexp_replace(head, "\r$", "")), r"^(\S*)", 1).alias("name"), origin.alias("source"), body.alias("seq")).where("name <> ''")


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, seq): the reads of a four-line format, the last one included; qualities aren't kept.

    Text is cut at a line break before '@'. A quality line that begins with '@' is cut off as well; such a part has no line
    with '+' as its third and is left out, so files of any size are split over tasks.
    """
    return fastq_records(spark.read.option("lineSep", "\n@").text(path))


def fastq_records(raw: DataFrame) -> DataFrame:
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "^@", ""), "\r", ""), "\n")
    rows = raw.select(lines.alias("l")).where("size(l) >= 3").where(F.startswith(F.get("l", F.lit(2)), F.lit("+")))
    return rows.select(F.regexp_extract(F.get("l", F.lit(0)), r"^(\S*)", 1).alias("name"), F.get("l", F.lit(1)).alias("seq"))


def sniff(spark: SparkSession, path: str) -> str:
    """'fasta' or 'fastq' by the first letter of a file; an empty file, and a packed one whose ending doesn't say so, are errors."""
    first = spark.read.text(path).where("length(value) > 0").first()
    if first is None:
        raise ValueError(f"{path} is empty")
    if first.value[0] == "\x1f":
        raise ValueError(f"{path} is packed by gzip; give its name the ending .gz, so that it is read as that")
    return "fastq" if first.value[0] == "@" else "fasta"


def sequences(spark: SparkSession, paths: list[str], first_sid: int = 0) -> DataFrame:
    """(sid, name, source, seq, len): records of several files with ids that go on over all of them.

    Every record has an id of its own, also where names repeat; ids follow the order of source, name and a hash of the bases.
    The source is the file's name without its endings, of either format.
    """
    from functools import reduce

    stem = lambda p: re.sub(r"(?:\.(?:fa|fasta|fna|fq|fastq))?(?:\.gz)?$", "", p.rstrip("/").rsplit("/", 1)[-1])
    rows = reduce(DataFrame.unionByName, [(fastq(spark, p) if sniff(spark, p) == "fastq" else fasta(spark, p).drop("source")).withColumn("source", F.lit(stem(p))) for p in paths])
    numbered = with_ids(rows.withColumn("h", F.xxhash64("seq")), ["source", "name", "h"], "sid", first_sid)
    return numbered.select(F.col("sid").cast("int"), "name", "source", "seq", F.length("seq").alias("len"))


def with_ids(df: DataFrame, order: list[str | Column], name: str, first: int = 0) -> DataFrame:
    """Consecutive ids in order, without a single-task window: rows are range-sorted and counted per partition first."""
    from strandframe.session import cut

    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = {r["_p"]: (r["n"], r["m"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("m")).collect()}  # one row a partition
    begins, at = {}, first
    for p in sorted(sizes):
        begins[p] = at - sizes[p][1]
        at += sizes[p][0]
    if not begins:
        return df.withColumn(name, F.lit(None).cast("long"))
    shift = F.create_map(*(F.lit(x) for kv in begins.items() for x in kv))
    return placed.withColumn(name, F.col("_m") + shift[F.col("_p")]).drop("_p", "_m")


def from_list(spark: SparkSession, records: list[tuple[str, str]], source: str = "Memory") -> DataFrame:
    """Sequences given in the program: (name, bases) pairs, numbered in order."""
    return spark.createDataFrame([(i, n, source, s, len(s)) for i, (n, s) in enumerate(records)], "sid int, name string, source string, seq string, len int")


def _table(spark: SparkSession, path, schema: str, comment: str | None = None) -> DataFrame:
    reader = spark.read.schema(StructType.fromDDL(schema)).option("sep", "\t").option("mode", "PERMISSIVE")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def midx(spark: SparkSession, path) -> DataFrame:
    """The catalog of an index: sid, length, contig, source ('-' is null)."""
    t = _table(spark, path, "sid int, len int, ctg string, source string")
    return t.withColumn("source", F.when(F.col("source") != "-", F.col("source")))


def bundle_bed(spark: SparkSession, path) -> DataFrame:
    """ctg, bgn, end_pos and the five or six values of the fourth column; comments and blank lines are skipped."""
    t = _table(spark, path, "ctg string, bgn int, end_pos int, info string", "#").where("info IS NOT NULL")
    part = F.split("info", ":")
    names = ("b_id", "b_size", "b_direction", "b_bgn", "b_end")
    return t.select("ctg", "bgn", "end_pos", *(part[i].cast("int").alias(n) for i, n in enumerate(names)), F.get(part, 5).alias("r_type"))


def gtf(spark: SparkSession, path, feature: str | None = "transcript") -> DataFrame:
    """chr, source, feature, b_bgn, b_end, score, strand, frame, attributes, gene; bounds as written."""
    t = _table(spark, path, "chr string, source string, feature string, b_bgn int, b_end int, score string, strand string, frame string, attributes string", "#")
    t = t.withColumn("gene", last_attribute("attributes"))
    return t if feature is None else t.where(F.col("feature") == feature)


def vcf(spark: SparkSession, path) -> DataFrame:
    return _table(spark, path, "chr string, pos int, id string, ref string, alt string, qual string, filter string, info string, format string, sample string", "#")


def regions(spark: SparkSession, path) -> DataFrame:
    """label, source, ctg, bgn, end_pos, strand (0 if absent)."""
    t = _table(spark, path, "label string, source string, ctg string, bgn int, end_pos int, strand int", "#")
    return t.withColumn("strand", F.coalesce("strand", F.lit(0)))


def gfa_links(spark: SparkSession, path) -> DataFrame:
    """a, b, w of the L lines; the weight is that of the SC tag, 1 without one."""
    part = F.split("value", "\t")
    weight = F.coalesce(F.nullif(F.regexp_extract("value", r"\tSC:i:(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return spark.read.text(path).where("startswith(value, 'L\t')").select(part[1].alias("a"), part[3].alias("b"), weight.alias("w"))


ALNMAP = ("t_name", "ts", "te", "q_name", "qs", "qe", "orientation")


def alnmap(spark: SparkSession, path) -> DataFrame:
    """Alignment records of all kinds in one wide table: block_id, rec_type and the columns that its kind has."""
    part = F.split("value", "\t")
    kind = part[1]
    int_ = lambda i: F.try_element_at(part, F.lit(i + 1)).cast("int")
    text = lambda i: F.try_element_at(part, F.lit(i + 1))
    when = lambda kinds, c: F.when(kind.isin(*kinds), c)
    ends, variants = ("B", "E"), ("V", "V_D", "V_O")
    common: list[Column] = [part[0].cast("int").alias("block_id"), kind.alias("rec_type"), *((text(i + 2) if n in ("t_name", "q_name") else int_(i + 2)).alias(n) for i, n in enumerate(ALNMAP))]
    own = [when(ends, int_(9)).alias("q_len"), F.coalesce(when(ends, int_(10)), F.when(kind.startswith("S"), int_(9))).alias("ctg_orientation"), F.when(kind.startswith("S"), text(10)).alias("diff_type")]
    own += [when(variants, int_(9 + i)).alias(n) for i, n in enumerate(("td", "qd", "tc"))] + [when(variants, text(12 + i)).alias(n) for i, n in enumerate(("vt", "t_str", "q_str"))]
    return spark.read.text(path).where("length(trim(value)) > 0 AND NOT startswith(value, '#')").select(*common, *own)


def block_intervals(records: DataFrame) -> DataFrame:
    """t_name, b_bgn, b_end of each block: from its begin record's start to its end record's end."""
    by = records.where("rec_type IN ('B', 'E')").groupBy("block_id").agg(F.max(F.when(F.col("rec_type") == "B", F.col("t_name"))).alias("t_name"), F.max(F.when(F.col("rec_type") == "B", F.col("ts"))).alias("b_bgn"), F.max(F.when(F.col("rec_type") == "E", F.col("te"))).alias("b_end"))
    return by.where("b_bgn IS NOT NULL AND b_end IS NOT NULL")


def json_rows(spark: SparkSession, path, schema: str) -> DataFrame:
    """Nested JSON documents (contig maps, lengths, bands, presets) with a given schema; one document may span lines."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def preset_search(presets: DataFrame, prefix: str) -> DataFrame:
    """Presets whose name begins with a prefix, in order."""
    return presets.where(F.col("name").startswith(prefix)).orderBy("name")


def index_records(spark: SparkSession, path) -> DataFrame:
    """The places in a binary index file: h0, h1, frg_id, sid, bgn, end_pos, orientation.

    Layout, little endian: 'mdb', five 32-bit numbers of the specification, the number of keys (64 bits); per key the two
    hashes and the number of places (64 bits each) and per place four 32-bit numbers and one byte.
    """
    import struct
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw[:3] != b"mdb":
                    raise ValueError("not an index file")
                (keys,), at = struct.unpack_from("<Q", raw, 23), 31
                out = []
                for _ in range(keys):
                    h0, h1, n = struct.unpack_from("<QQQ", raw, at)
                    at += 24
                    out += [(h0, h1, *struct.unpack_from("<IIIIB", raw, at + 17 * i)) for i in range(n)]
                    at += 17 * n
                    if len(out) > 50_000:
                        yield _places(out)
                        out = []
                yield _places(out)

    def _places(rows):
        cols = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h0", "h1", "frg_id", "sid", "bgn", "end_pos", "orientation"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "h0 long, h1 long, frg_id int, sid int, bgn int, end_pos int, orientation int")


def gff3(spark: SparkSession, path) -> DataFrame:
    """seqid, source, type_name, bgn, end_pos, score, strand, phase, attributes (a map) and id, name, parent; comments are skipped."""
    t = _table(spark, path, "seqid string, source string, type_name string, bgn long, end_pos long, score string, strand string, phase string, attributes string", "#").where("attributes IS NOT NULL")
    known = lambda c, kind: F.when(F.col(c) != ".", F.col(c)).cast(kind)
    a = attribute_map("attributes")
    t = t.select("seqid", "source", "type_name", "bgn", "end_pos", known("score", "float").alias("score"), "strand", known("phase", "tinyint").alias("phase"), a.alias("attributes"))
    return t.select("*", *(F.col("attributes")[k].alias(n) for k, n in (("ID", "id"), ("Name", "name"), ("Parent", "parent"))))


def probes(spark: SparkSession, path) -> DataFrame:
    """Probe lists: vname, vprobe, t1name, t1probe, t2name, t2probe."""
    return _table(spark, path, "vname string, vprobe string, t1name string, t1probe string, t2name string, t2probe string", "#")


def dendrogram(spark: SparkSession, path) -> DataFrame:
    """Rows of a drawn tree: kind L (leaf: node, name), I (inner: node, left, right, size, height) or P (place: node, x, height, size)."""
    p = F.split("value", "\t")
    at = lambda i, kind: F.get(p, F.lit(i)).cast(kind)
    when = lambda kind, c: F.when(p[0] == kind, c)
    return spark.read.text(path).where("value rlike '^[LIP]\t'").select(p[0].alias("kind"), at(1, "int").alias("node"), when("L", at(2, "string")).alias("name"), when("I", at(2, "string")).cast("int").alias("left"), when("I", at(3, "string")).cast("int").alias("right"),
        F.coalesce(when("I", at(4, "string")), when("P", at(4, "string"))).cast("int").alias("size"), when("P", at(2, "string")).cast("double").alias("x"), F.coalesce(when("I", at(5, "string")), when("P", at(3, "string"))).cast("double").alias("height"))
