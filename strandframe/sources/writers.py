"""Writers: each formats rows to text in the plan and lets Spark write the parts in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandframe.functions.dna import pair_name, reverse_complement


def fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", turned: str | None = None) -> None:
    """Records of (name, seq); where ``turned`` is 1 the reverse complement is written."""
    s = F.when(F.col(turned) == 1, reverse_complement(seq)).otherwise(F.col(seq)) if turned else F.col(seq)
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), s).alias("value")).write.mode("overwrite").text(path)


def tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", str(header).lower()).option("quote", "").csv(path)


def midx(catalog: DataFrame, path: str) -> None:
    """sid, length, contig, source of an index; a null source is written as '-'."""
    tsv(catalog.select("sid", "len", "name", F.coalesce("source", F.lit("-")).alias("source")), path)


def index(pairs: DataFrame, path: str, buckets: int | None = None) -> None:
    """The pair table, sorted by key within files, so that a probe's filter reads few row groups."""
    placed = pairs.repartition(buckets, "h0", "h1") if buckets else pairs.repartition("h0", "h1")
    placed.sortWithinPartitions("h0", "h1").write.mode("overwrite").option("compression", "zstd").parquet(path)


def sequence_store(sequences: DataFrame, path: str, records: int = 100_000) -> None:
    """Sequences as a table partitioned by source, the form in which archives of samples are kept."""
    sequences.write.mode("overwrite").partitionBy("source").option("maxRecordsPerFile", records).option("compression", "zstd").parquet(path)


def gfa_lines(segments: DataFrame, links: DataFrame, k: int, bundles: DataFrame | None = None) -> DataFrame:
    """(tag, value): the lines of a GFA 1.0 graph. segments: (h0, h1, length, n); links as gfa_links gives them.

    Segments are numbered in order of their hashes and carry their pair in the tag SN. With ``bundles`` (h0, h1, bundle_id, pos) those
    in a bundle carry the tags BN and BP.
    """
    from strandframe.sources.readers import with_ids

    ids = with_ids(segments.select("h0", "h1", "length"), ["h0", "h1"], "id")
    s = ids.withColumn("tags", F.concat_ws("\t", F.concat(F.lit("LN:i:"), F.col("length")), F.concat(F.lit("SN:Z:"), pair_name("h0", "h1"))))
    if bundles is not None:
        s = s.join(bundles.select("h0", "h1", "bundle_id", "pos"), ["h0", "h1"], "left").withColumn("tags", F.concat_ws("\t", "tags", F.concat(F.lit("BN:i:"), F.col("bundle_id")), F.concat(F.lit("BP:i:"), F.col("pos"))))
    line = F.concat_ws("\t", F.lit("S"), F.col("id").cast("string"), F.lit("*"), "tags")
    of = lambda p: ids.select(F.col("h0").alias(f"{p}_h0"), F.col("h1").alias(f"{p}_h1"), F.col("id").cast("string").alias(f"{p}_id"))
    sign = lambda c: F.when(F.col(c) == 0, "+").otherwise("-")
    named = links.join(of("v"), ["v_h0", "v_h1"]).join(of("w"), ["w_h0", "w_h1"])
    link = F.concat_ws("\t", F.lit("L"), "v_id", sign("v_ori"), "w_id", sign("w_ori"), F.lit(f"{k}M"), F.concat(F.lit("SC:i:"), F.col("n")))
    head = segments.sparkSession.createDataFrame([(0, "H\tVN:Z:1.0\tCM:Z:sparse genome graph")], "tag int, value string")
    return head.union(s.select(F.lit(1), line)).union(named.select(F.lit(2), link))


def gfa(segments: DataFrame, links: DataFrame, k: int, path: str, bundles: DataFrame | None = None) -> None:
    gfa_lines(segments, links, k, bundles).orderBy("tag").select("value").write.mode("overwrite").text(path)


def map_index_lines(pairs: DataFrame, catalog: DataFrame, spec: tuple) -> DataFrame:
    """(tag, value): K (specification), C (sequence: sid, name, source or NA, length) and F rows of a text index.

    An F row is a place of a pair: the pair, the place's number within its sequence, sid, begin, end and orientation.
    """
    k = pairs.sparkSession.createDataFrame([(0, "K\t" + "\t".join(str(x).lower() for x in spec))], "tag int, value string")
    c = catalog.select(F.lit(1), F.concat_ws("\t", F.lit("C"), F.col("sid").cast("string"), "name", F.coalesce("source", F.lit("NA")), F.col("len").cast("string")))
    f = pairs.select(F.lit(2), F.concat_ws("\t", F.lit("F"), pair_name("h0", "h1"), *(F.col(x).cast("string") for x in ("ord", "sid", "bgn", "end_pos", "orientation"))))
    return k.union(c).union(f)


def map_index(pairs: DataFrame, catalog: DataFrame, spec: tuple, path: str) -> None:
    map_index_lines(pairs, catalog, spec).orderBy("tag").select("value").write.mode("overwrite").text(path)


def bundle_bed_lines(runs: DataFrame) -> DataFrame:
    """(value): stretches (ctg, bgn, end_pos, bundle_id, size, dir, v_bgn, v_end, flag) in the four-column form."""
    info = F.concat_ws(":", *(F.col(c).cast("string") for c in ("bundle_id", "size", "dir", "v_bgn", "v_end")), "flag")
    return runs.select(F.concat_ws("\t", "ctg", F.col("bgn").cast("string"), F.col("end_pos").cast("string"), info).alias("value"))


def hits_table(regions: DataFrame, path: str) -> None:
    """Hit regions with a heading that names every column."""
    tsv(regions, path, header=True)


def bedgraph(coverage: DataFrame, path: str) -> None:
    tsv(coverage.select("ctg", "bgn", "end_pos", F.format_number("ratio", 6).alias("ratio")), path)


def vcf_lines(variants: DataFrame, lengths: DataFrame, sample: str) -> DataFrame:
    """(tag, ord, pos, value): a VCF 4.2 file of genotypes (t_name, pos, ref, alt, gt); lengths: (t_name, len)."""
    head = [(0, "##fileformat=VCFv4.2"), (2, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'), (3, f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}")]
    top = variants.sparkSession.createDataFrame([(t, "", 0, v) for t, v in head], "tag int, ord string, pos int, value string")
    contigs = lengths.select(F.lit(1), F.col("t_name").cast("string"), F.lit(0), F.format_string("##contig=<ID=%s,length=%d>", F.col("t_name").cast("string"), F.col("len")))
    rows = variants.select(F.lit(4), F.col("t_name").cast("string"), "pos", F.concat_ws("\t", F.col("t_name").cast("string"), F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("60"), F.lit("PASS"), F.lit("."), F.lit("GT"), "gt"))
    return top.union(contigs).union(rows)


def vcf(variants: DataFrame, lengths: DataFrame, sample: str, path: str) -> None:
    vcf_lines(variants, lengths, sample).orderBy("tag", "ord", "pos").select("value").write.mode("overwrite").text(path)


def alnmap_lines(records: DataFrame, ends: DataFrame) -> DataFrame:
    """(block_id, value): begin, end and inner records of alignment blocks. records and ends as the variant operators give them."""
    place = lambda: [F.col(c).cast("string") for c in ("sid", "ts", "te", "q_sid", "qs", "qe", "orientation")]
    kind = F.when((F.col("rec_type") == "V") & F.col("t_dup"), "V_D").when((F.col("rec_type") == "V") & F.col("t_ovlp"), "V_O").otherwise(F.col("rec_type"))
    tail = F.when(F.col("rec_type") == "V", F.concat_ws("\t", *(F.col(c).cast("string") for c in ("td", "qd")), (F.col("ts") + F.col("td")).cast("string"), "vt", "t_str", "q_str")).when(F.col("rec_type") == "S", F.concat_ws("\t", F.col("ctg_orientation").cast("string"), "diff_type"))
    inner = records.select("block_id", F.concat_ws("\t", "block_id", kind, *place(), tail).alias("value"))
    both = ends.withColumn("block_id", F.concat_ws("_", "q_sid", "sid", "chain"))
    outer = both.select("block_id", F.explode(F.array(F.lit("B"), F.lit("E"))).alias("t"), "sid", "ts", "te", "q_sid", "qs", "qe", "orientation").select("block_id", F.concat_ws("\t", "block_id", "t", *place()).alias("value"))
    return inner.union(outer)


def dendrogram_lines(names: list[str], merges: list[tuple[int, int, float, int]]) -> list[str]:
    """The lines of a drawn tree of drawing size: its leaves L in the order of the tree, its inner nodes I, and the place P of each.

    ``merges`` are those of ``average_linkage``: (left, right, height, size), inner nodes counted on from the leaves. Leaves lie side by
    side, an inner node at the mean place of its leaves.
    """
    n = len(names)
    below: list[list[int]] = [[i] for i in range(n)]
    for left, right, _, _ in merges:
        below.append(below[left] + below[right])
    order = below[-1] if merges else list(range(n))
    place = {leaf: float(i) for i, leaf in enumerate(order)}
    lines = [f"L\t{leaf}\t{names[leaf]}" for leaf in order]
    lines += [f"I\t{n + i}\t{left}\t{right}\t{size}\t{height}" for i, (left, right, height, size) in enumerate(merges)]
    height = [0.0] * n + [h for _, _, h, _ in merges]
    return lines + [f"P\t{i}\t{sum(place[x] for x in own) / len(own)}\t{height[i]}\t{len(own)}" for i, own in enumerate(below)]


def bundle_order(ordered: DataFrame, path: str) -> None:
    """Contigs with their vectors of counts, as ``bundle_count_order`` gives them."""
    tsv(ordered.sort("ord").select("ctg", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts")), path)


def offsets(shifts: DataFrame, path: str) -> None:
    """Contigs with their offsets; 0 where nothing aligns."""
    tsv(shifts.select("ctg", F.coalesce("offset", F.lit(0)).alias("offset")), path)


def contig_map_lines(ends: DataFrame) -> DataFrame:
    """(value): a row of each block: its place on the target, and place, length, orientations and tags on the query.

    ``ends`` has t_name, ts, te, q_name, qs, qe, q_len, orientation, ctg_orientation, t_dup, t_ovlp, q_dup and q_ovlp.
    """
    info = F.concat_ws(":", *(F.col(c).cast("string") for c in ("q_name", "qs", "qe", "q_len", "orientation", "ctg_orientation", "t_dup", "t_ovlp", "q_dup", "q_ovlp")))
    return ends.select(F.concat_ws("\t", "t_name", F.col("ts").cast("string"), F.col("te").cast("string"), info).alias("value"))


def tile_lines(tiles: DataFrame, side: str, target: str = "t_name") -> DataFrame:
    """(value): gaps, overlaps and duplicates along the targets (``side`` T) or the queries (Q), as ``tiling`` gives them."""
    note = F.concat_ws(":", F.concat(F.lit(side), "kind"), F.coalesce(F.col("block_id").cast("string"), F.lit("END")))
    return tiles.select(F.concat_ws("\t", F.col(target).cast("string"), F.col("bgn").cast("string"), F.col("end_pos").cast("string"), note).alias("value"))


def lengths_json(catalog: DataFrame, path: str) -> None:
    """Lengths as one JSON list of [sid, name, length]; a catalog of contigs, without bases."""
    entry = F.concat(F.lit("["), F.col("sid").cast("string"), F.lit(","), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(","), F.col("len").cast("string"), F.lit("]"))
    all_ = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sid", entry.alias("e")))), lambda x: x["e"]), ",")
    catalog.agg(F.concat(F.lit("["), all_, F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def plot_layout(runs: DataFrame, scale: float = 0.01) -> DataFrame:
    """(ctg, x, width, hue_a, hue_b, dir): the boxes of a plot of stretches; drawing them is left to any renderer."""
    from strandframe.functions.dna import hue

    return runs.select("ctg", (F.col("bgn") * scale).alias("x"), ((F.col("end_pos") - F.col("bgn")) * scale).alias("width"), hue("bundle_id")["a"].alias("hue_a"), hue("bundle_id")["b"].alias("hue_b"), "dir")
