"""One object for a collection of sequences: loading, indexing, queries, graph and bundles, all as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import strandframe
from strandframe.functions import dna
from strandframe.operators import align as A, bundles as B, chains as H, consensus as K, graph as G, overlap as V, pairs as P
from strandframe.operators.shimmers import ShimmerSpec, shimmer_pairs, shimmers
from strandframe.session import cut, stored
from strandframe.sources import readers as R, writers as W


def version() -> str:
    return strandframe.__version__


class Pangenome:
    """Sequences (sid, name, source, seq, len) with their pair index under one specification."""

    def __init__(self, sequences: DataFrame, spec: ShimmerSpec | None = None) -> None:
        self.spark: SparkSession = sequences.sparkSession
        self.sequences, self.spec = sequences, spec or ShimmerSpec()
        self._pairs: DataFrame | None = None

    # -------------------------------------------------- loading and storing

    @classmethod
    def from_files(cls, spark: SparkSession, paths: list[str], spec: ShimmerSpec | None = None) -> Pangenome:
        return cls(R.sequences(spark, paths), spec)

    @classmethod
    def from_list(cls, spark: SparkSession, records: list[tuple[str, str]], source: str = "Memory", spec: ShimmerSpec | None = None) -> Pangenome:
        return cls(R.from_list(spark, records, source), spec or ShimmerSpec(min_span=8))

    @classmethod
    def from_store(cls, spark: SparkSession, path: str) -> Pangenome:
        """A stored collection: sequences by source, the pair index, and the specification."""
        s = spark.read.parquet(f"{path}/spec").first()
        out = cls(spark.read.parquet(f"{path}/sequences"), ShimmerSpec(s.w, s.k, s.r, s.min_span, s.sketch))
        out._pairs = spark.read.parquet(f"{path}/pairs")
        return out

    def append_files(self, paths: list[str]) -> Pangenome:
        """A collection with more sequences; their ids go on behind the largest one."""
        last = self.sequences.agg(F.max("sid")).first()[0]
        return Pangenome(self.sequences.unionByName(R.sequences(self.spark, paths, 0 if last is None else last + 1)), self.spec)

    def save(self, path: str) -> None:
        W.sequence_store(self.sequences, f"{path}/sequences")
        W.index(self.pairs, f"{path}/pairs")
        s = self.spec
        self.spark.createDataFrame([(s.w, s.k, s.r, s.min_span, s.sketch)], "w int, k int, r int, min_span int, sketch boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")

    # -------------------------------------------------- catalog and bases

    @property
    def catalog(self) -> DataFrame:
        return self.sequences.select("sid", "name", "source", F.length("seq").alias("len"))

    def sequence(self, source: str, name: str) -> DataFrame:
        return self.sequences.where((F.col("source") == source) & (F.col("name") == name)).select("seq")

    def sequence_by_id(self, sid: int) -> DataFrame:
        return self.sequences.where(F.col("sid") == sid).select("seq")

    def subsequence(self, source: str, name: str, bgn: int, end: int) -> DataFrame:
        return self.sequence(source, name).select(dna.subsequence("seq", F.lit(bgn), F.lit(end)).alias("seq"))

    def subsequence_by_id(self, sid: int, bgn: int, end: int) -> DataFrame:
        return self.sequence_by_id(sid).select(dna.subsequence("seq", F.lit(bgn), F.lit(end)).alias("seq"))

    def fetch(self, regions: DataFrame) -> DataFrame:
        """(label, seq): regions (label, source, ctg, bgn, end_pos, strand), reverse complemented where strand is 1."""
        met = regions.join(self.sequences.select("source", F.col("name").alias("ctg"), "seq"), ["source", "ctg"])
        part = dna.subsequence("seq", "bgn", "end_pos")
        return met.select("label", F.when(F.col("strand") == 1, dna.reverse_complement(part)).otherwise(part).alias("seq"))

    # -------------------------------------------------- index

    @property
    def pairs(self) -> DataFrame:
        return self._pairs if self._pairs is not None else shimmer_pairs(self.sequences, self.spec)

    @property
    def marks(self) -> DataFrame:
        return shimmers(self.sequences, self.spec)

    def pair_count(self, h0: int, h1: int) -> DataFrame:
        return P.pair_count(self.pairs, h0, h1)

    def pair_source_count(self, h0: int, h1: int, max_unique: int | None = None) -> DataFrame:
        one = self.pairs.where((F.col("h0") == h0) & (F.col("h1") == h1))
        return P.pair_source_counts(one, self.catalog, max_unique)

    def postings(self) -> DataFrame:
        return P.postings(self.pairs)

    # -------------------------------------------------- queries

    def _asked(self, queries: DataFrame) -> DataFrame:
        return shimmer_pairs(queries, self.spec, query=True)

    def query_fragment(self, queries: DataFrame) -> DataFrame:
        """Hits of queries (sid, seq); query pairs without a hit keep a row of nulls."""
        return P.hits(self._asked(queries), self.pairs)

    def match_positions(self, queries: DataFrame) -> DataFrame:
        return P.match_positions(self._asked(queries), self.pairs)

    def chains(self, queries: DataFrame, penalty: float = 0.025, max_count: int = 128, max_query: int = 128, max_target: int = 128, max_span: int = 8, max_gap: int | None = None, oriented: bool = False) -> DataFrame:
        found = P.suppressed_hits(self._asked(queries), self.pairs, max_count, max_query, max_target)
        return H.sparse_chains(found, max_span, penalty, max_gap, oriented)

    def query(self, queries: DataFrame, tolerance: int = 100_000, per_chain: bool = False, **how) -> DataFrame:
        """Target regions of each query; ``how`` goes to ``chains``."""
        return H.query_regions(H.chain_ranges(self.chains(queries, **how), per_chain=per_chain), tolerance)

    def hit_table(self, queries: DataFrame, tolerance: int = 100_000, **how) -> DataFrame:
        """The table of target regions of queries (sid, name, seq), in the twelve columns of hit files.

        Positions of the query are those of the first and last anchor of a region; regions are named after the target.
        """
        found = self.query(queries, tolerance, **how)
        asked = queries.select(F.col("sid").alias("q_sid"), F.col("name").alias("q_ctg_name"), F.length("seq").alias("q_ctg_len"))
        met = found.join(asked, "q_sid").join(self.catalog.select("sid", F.col("name").alias("ctg"), F.coalesce("source", F.lit("N/A")).alias("src")), "sid")
        region = dna.region_name(dna.file_stem("src"), F.col("ctg"), F.col("bgn").cast("string"), F.col("end_pos").cast("string"), F.col("orientation").cast("string"))
        return met.select(F.col("q_sid").alias("idx"), "q_ctg_name", F.col("q_bgn").alias("q_ctg_bgn"), F.col("q_end").alias("q_ctg_end"), "q_ctg_len", F.col("anchors").alias("aln_anchor_count"), "src", "ctg", F.col("bgn").alias("ctg_bgn"), F.col("end_pos").alias("ctg_end"), "orientation", region.alias("ctg_name"))

    def hit_sequences(self, hits: DataFrame) -> DataFrame:
        """(name, seq): the bases of the regions in a hit table, reverse complemented where they lie backward."""
        met = hits.join(self.sequences.select(F.coalesce("source", F.lit("N/A")).alias("src"), F.col("name").alias("ctg"), "seq"), ["src", "ctg"])
        part = dna.subsequence("seq", "ctg_bgn", "ctg_end")
        return met.select(F.col("ctg_name").alias("name"), F.when(F.col("orientation") == 1, dna.reverse_complement(part)).otherwise(part).alias("seq"))

    def map_positions(self, queries: DataFrame, positions: DataFrame, **how) -> DataFrame:
        """(q_sid, sid, pos, left_bgn, right_end): the anchors around positions (q_sid, pos), per target of the best chain."""
        anchors = self.chains(queries, **how).where("chain = 0").select("q_sid", "sid", "q_bgn", "q_end")
        asked = positions.join(anchors.select("q_sid", "sid").distinct(), "q_sid")
        return V.brackets(asked, anchors, ["q_sid", "sid"])

    def map_bases(self, queries: DataFrame, positions: DataFrame, **how) -> DataFrame:
        """(q_sid, sid, pos, t_pos, orientation, same): the base of each target that is aligned with a base of a query.

        ``queries`` has (sid, seq), ``positions`` (q_sid, pos). Of the best chain of each target the anchors around a position are
        taken, and what lies between them is aligned; positions without anchors on both sides, in one orientation, have no row.
        """
        by = ["q_sid", "sid"]
        anchors = stored(self.chains(queries, **how).where("chain = 0").select(*by, "q_bgn", "q_end", "bgn", "end_pos", (F.col("q_orientation") != F.col("orientation")).cast("int").alias("orientation")))
        around = V.brackets(positions.join(anchors.select(*by).distinct(), "q_sid"), anchors, by)
        side = lambda end, name: anchors.groupBy(*by, F.col(end).alias(name)).agg(F.min(F.struct("bgn", "end_pos", "orientation")).alias(f"{name}_at"))
        met = around.join(side("q_bgn", "left_bgn"), [*by, "left_bgn"]).join(side("q_end", "right_end"), [*by, "right_end"])
        met = met.where("left_bgn_at.orientation = right_end_at.orientation").withColumn("orientation", F.col("left_bgn_at.orientation"))
        turned = F.col("orientation") == 1
        # places are ends of k-mers; on the other strand the same bases end where the k-mer begins
        k = self.spec.k
        met = met.withColumn("t_bgn", F.when(turned, F.col("right_end_at.bgn") - k).otherwise(F.col("left_bgn_at.bgn"))).withColumn("t_end", F.when(turned, F.col("left_bgn_at.end_pos") - k).otherwise(F.col("right_end_at.end_pos"))).where("t_bgn >= 0 AND t_bgn < t_end")
        met = met.join(self.sequences.select("sid", F.col("seq").alias("t_all")), "sid").join(queries.select(F.col("sid").alias("q_sid"), F.col("seq").alias("q_all")), "q_sid")
        part = F.upper(dna.subsequence("t_all", "t_bgn", "t_end"))
        rows = met.select(*by, "pos", "orientation", "t_bgn", "t_end", F.when(turned, dna.reverse_complement(part)).otherwise(part).alias("t_seq"), F.upper(F.expr("substring(q_all, left_bgn + 1, right_end - left_bgn)")).alias("q_seq"), (F.col("pos") - F.col("left_bgn")).cast("int").alias("at"))
        found = A.projected(rows, [*by, "pos", "orientation", "t_bgn", "t_end"])
        return found.select(*by, "pos", F.when(turned, F.col("t_end") - 1 - F.col("t_at")).otherwise(F.col("t_bgn") + F.col("t_at")).alias("t_pos"), "orientation", "same")

    # -------------------------------------------------- graph and bundles

    def adjacency(self, least: int = 0, keeps: list[int] | None = None) -> DataFrame:
        return P.edges(self.pairs, least, keeps)

    def weighted_order(self, least: int = 0) -> DataFrame:
        return G.weighted_order(self.adjacency(least), P.pair_counts(self.pairs))

    def bundles(self, least: int = 0, cutoff: int = 8) -> DataFrame:
        """Principal bundles (bundle_id, mean_order, pos, h0, h1, ori) in the direction of the vote."""
        found = cut(G.bundle_ids(G.principal_bundles(self.adjacency(least), P.pair_counts(self.pairs), cutoff)))
        return B.orient_bundles(found, B.bundle_votes(B.decompose(self.pairs, B.vertex_map(found))))

    def decomposition(self, bundles: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
        """Places with their bundles, of this collection or, projected, of other sequences (sid, seq)."""
        pairs = self.pairs if sequences is None else shimmer_pairs(sequences, self.spec)
        return B.decompose(pairs, B.vertex_map(bundles))

    def write_gfa(self, path: str, least: int = 0, bundles: DataFrame | None = None) -> None:
        links = P.gfa_links(self.adjacency(least))
        if bundles is not None:
            known = B.vertex_map(bundles).select("h0", "h1")
            for p in ("v", "w"):
                links = links.join(known.toDF(f"{p}_h0", f"{p}_h1"), [f"{p}_h0", f"{p}_h1"], "left_semi")
        W.gfa(P.segments(self.pairs, self.spec.k), links, self.spec.k, path, None if bundles is None else B.vertex_map(bundles))

    def write_map_index(self, path: str) -> None:
        s = self.spec
        W.map_index(self.pairs, self.catalog, (s.w, s.k, s.r, s.min_span, s.sketch), path)

    def write_midx(self, path: str) -> None:
        W.midx(self.catalog, path)

    def bundle_bed(self, bundles: DataFrame, min_length: int = 2500, merge_distance: int = 10_000) -> DataFrame:
        """(ctg, bgn, end_pos, bundle_id, size, dir, v_bgn, v_end, flag): the stretches of the bundles along the sequences."""
        runs = B.bundle_runs(self.decomposition(bundles), min_length, merge_distance)
        size = bundles.groupBy("bundle_id").agg(F.count("*").alias("size"))
        named = runs.join(size, "bundle_id").join(self.catalog.select("sid", F.col("name").alias("ctg")), "sid")
        return B.repeat_flags(named, "ctg", "bundle_id").select("ctg", "bgn", "end_pos", "bundle_id", "size", "dir", "v_bgn", "v_end", "flag")

    def consensus(self, groups: DataFrame, by: str, method: str = "sparse", min_cov: int = 2) -> DataFrame:
        """Consensus of groups of this collection's sequences: groups has (by, sid)."""
        return K.consensus(groups.join(self.sequences.select("sid", "seq"), "sid"), by, method, min_cov)


def register_sql(spark: SparkSession) -> None:
    """SQL functions: shimmer_marks(seq, w, k, r, min_span, sketch) as a table function for LATERAL, and reverse_complement(seq)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="ord int, hash long, pos int, strand int")
    class Marks:
        def eval(self, seq: str, w: int, k: int, r: int, min_span: int, sketch: bool):
            from strandframe.operators.shimmers import sequence_marks

            h, p, s = sequence_marks((seq or "").encode("ascii", "replace"), ShimmerSpec(w, k, r, min_span, sketch))
            for i in range(len(h)):
                yield i, int(h[i]), int(p[i]), int(s[i])

    spark.udtf.register("shimmer_marks", Marks)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))")
