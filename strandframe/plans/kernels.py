"""Queries of the operators over bases, chains and graphs. Where SQL can't give the same rows, tests hold them against slow versions and properties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.operators import align as A, bundles as B, chains as H, consensus as K, graph as G, pairs as P, variants as X
from strandframe.operators.shimmers import ShimmerSpec, shimmer_pairs as make_pairs, shimmers
from strandframe.plans import catalog as C
from strandframe.session import cut, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# One value for each base, of its low and high bit; the k-mer that ends at a letter that isn't a base is the one before it again.
_SKETCH = """seqs AS (SELECT DISTINCT sid, name, source, seq FROM sequences),
pure AS MATERIALIZED (SELECT sid, regexp_replace(upper(seq), '[^ACGT]', '', 'g') AS s, regexp_replace(upper(seq), '[^ACGT]', '-', 'g') AS m FROM seqs WHERE length(seq) > 24),
place AS (SELECT sid, s, m, CAST(unnest(range(24, length(m))) AS INTEGER) AS p FROM pure),
seen AS (SELECT sid, p, s, CASE WHEN length(s) = length(m) THEN p + 1 ELSE length(replace(left(m, p + 1), '-', '')) END AS n FROM place),
mer AS (SELECT sid, p, substr(s, greatest(n - 23, 1), least(n, 24)) AS f FROM seen WHERE n > 0),
bits AS (SELECT sid, p, ('0b' || lpad(translate(f, 'ACGT', '0101'), 24, '0'))::UBIGINT::HUGEINT AS fl, ('0b' || lpad(translate(f, 'ACGT', '0011'), 24, '0'))::UBIGINT::HUGEINT AS fh,
  ('0b' || rpad(translate(reverse(f), 'ACGT', '1010'), 24, '0'))::UBIGINT::HUGEINT AS rl, ('0b' || rpad(translate(reverse(f), 'ACGT', '1100'), 24, '0'))::UBIGINT::HUGEINT AS rh FROM mer),
side AS (SELECT sid, p, CAST(rl < fl AS INTEGER) AS strand, CASE WHEN rl < fl THEN rl ELSE fl END AS a0, xor(CASE WHEN rl < fl THEN rh ELSE fh END, 2903691097::HUGEINT) AS b0 FROM bits WHERE fl <> rl OR fh <> rh),
""" + ",\n".join(
    f"s{i + 1} AS (SELECT sid, p, strand, {step.format(k=f'a{i}')} AS a{i + 1}, {step.format(k=f'b{i}')} AS b{i + 1} FROM {'side' if not i else f's{i}'})"
    for i, step in enumerate((
        "(18446744073709551615::HUGEINT - {k} + {k} * 2097152) % 18446744073709551616", "xor({k}, {k} // 16777216)", "({k} * 265) % 18446744073709551616", "xor({k}, {k} // 16384)",
        "({k} * 21) % 18446744073709551616", "xor({k}, {k} // 268435456)", "({k} + {k} * 2147483648) % 18446744073709551616",
    ))
) + """,
kept AS (SELECT sid, p, strand, CAST(xor(a7, b7) % 72057594037927936 AS BIGINT) AS hash FROM s7 WHERE xor(a7, b7) < 576460752303423487),
near AS (SELECT *, lag(p) OVER w AS bp, lead(p) OVER w AS np, lag(hash) OVER w AS bh, lead(hash) OVER w AS nh FROM kept WINDOW w AS (PARTITION BY sid ORDER BY p)),
sketch AS (SELECT sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY p) - 1 AS INTEGER) AS ord, hash, p, strand FROM near WHERE bp IS NULL OR np IS NULL OR (p - bp > 8 AND np - p > 8 AND hash <> bh AND hash <> nh))"""  # fmt: skip

SKETCH = ShimmerSpec(80, 24, 1, 8, True)
WINDOWED = ShimmerSpec(48, 24, 2, 8, False)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _pairs(spark, base) -> DataFrame:
    return make_pairs(C.sequences(spark, base).select("sid", "seq"), SKETCH)


@query
def shimmers_sketch(spark, base):
    return shimmers(C.sequences(spark, base), SKETCH)


@query
def shimmers_minimizer(spark, base):
    return shimmers(C.sequences(spark, base), WINDOWED)


@query
def sketch_pair_sources(spark, base):
    return P.pair_source_counts(_pairs(spark, base), C.catalog(spark, base))


def _chains(spark, base) -> DataFrame:
    index = stored(_pairs(spark, base))  # the bases are read once; what follows reads pairs
    # as a query a pair of equal hashes has orientation 1
    asked = index.where("sid % 50 = 0").withColumn("orientation", F.when(F.col("h0") == F.col("h1"), 1).otherwise(F.col("orientation")))
    return H.sparse_chains(P.suppressed_hits(asked, index))


@query
def sparse_chains(spark, base):
    """Chains of every sequence whose id is divisible by 50 against all sequences."""
    return _chains(spark, base)


@query
def query_regions(spark, base):
    return H.query_regions(H.chain_ranges(_chains(spark, base)), 1000)


@query
def hit_summary(spark, base):
    return H.strong_hits(H.hit_summary(H.chain_ranges(_chains(spark, base))), 5, 0.6)


@query
def largest_block(spark, base):
    return H.largest_block(H.chain_ranges(_chains(spark, base)))


def _graph(spark, base) -> tuple[DataFrame, DataFrame]:
    pairs = cut(_pairs(spark, base))
    return P.edges(pairs, 2), P.pair_counts(pairs)


@query
def weighted_dfs(spark, base):
    return G.weighted_order(*_graph(spark, base))


def _bundles(spark, base) -> tuple[DataFrame, DataFrame]:
    pairs = cut(_pairs(spark, base))
    found = cut(G.bundle_ids(G.principal_bundles(P.edges(pairs, 2), P.pair_counts(pairs), 4)))
    votes = B.bundle_votes(B.decompose(pairs, B.vertex_map(found)))
    return pairs, B.orient_bundles(found, votes)


@query
def principal_bundles(spark, base):
    return _bundles(spark, base)[1]


@query
def decomposition(spark, base):
    pairs, bundles = _bundles(spark, base)
    return B.bundle_runs(B.decompose(pairs, B.vertex_map(bundles)), 100, 500)


@query
def graph_entropy(spark, base):
    links = P.gfa_links(_graph(spark, base)[0])
    node = lambda p: F.concat_ws("_", F.col(f"{p}_h0").cast("string"), F.col(f"{p}_h1").cast("string"))
    return G.diffusion_entropy(links.select(node("v").alias("a"), node("w").alias("b"), F.col("n").cast("double").alias("w")), 4)


def _listed(spark, base) -> DataFrame:
    """The contigs that are compared with all: those of the sequences whose id is divisible by 50."""
    return C.catalog(spark, base).where("sid % 50 = 0").select(F.col("name").alias("ctg"))


@query
def bundle_distance(spark, base):
    segments = C.stretches(spark, base)
    return B.bundle_distances(segments, _listed(spark, base), segments.select("ctg"))


@query
def bundle_linkage(spark, base):
    """Average linkage of the contigs with the most stretches, at most 200: a tree is drawn, so it is small by purpose."""
    top = C.stretches(spark, base).groupBy("ctg").count().orderBy(F.desc("count"), "ctg").limit(200).select("ctg")
    rows = B.bundle_distances(C.stretches(spark, base), top).collect()
    names = sorted({r.a for r in rows})
    merges, _ = B.average_linkage(names, {(r.a, r.b): r.distance for r in rows})
    return spark.createDataFrame([(i, a, b, float(h), n) for i, (a, b, h, n) in enumerate(merges)], "merge int, a int, b int, height double, size int")


@query
def bundle_offset(spark, base):
    anchor = C.stretches(spark, base).groupBy("ctg").count().orderBy(F.desc("count"), "ctg").first()
    return B.bundle_offsets(C.stretches(spark, base), anchor.ctg if anchor else "")


def _records(spark, base) -> tuple[DataFrame, DataFrame]:
    families = stored(_families(spark, base).select("sid", "seq", "family"))
    first = families.groupBy("family").agg(F.min("sid").alias("sid")).select("sid", F.lit(True).alias("first"))
    marked = stored(families.join(first, "sid", "left").select("sid", "seq", "first"))
    reference, contigs = marked.where("first").drop("first"), marked.where("first IS NULL").drop("first")
    spec = ShimmerSpec(32, 24, 1, 8, True)
    # the bases of both are read once; the search for unique pairs reads either pairs twice
    chains = X.unique_chains(stored(make_pairs(contigs, spec, query=True)), stored(make_pairs(reference, spec)), max_gap=5000)
    segments = cut(X.blocks(chains, spec.k))
    return X.alignment_records(segments, reference, contigs), X.block_ends(segments)


@query
def sv_candidates(spark, base):
    """Records of all contigs against the first sequence of each family, tagged with duplicate and overlapping blocks."""
    return X.tagged_records(*_records(spark, base))


@query
def diploid_genotypes(spark, base):
    records, ends = _records(spark, base)
    v = records.where("rec_type = 'V'").select(F.col("sid").alias("t_name"), (F.col("ts") + F.col("td")).alias("ts"), F.length("t_str").alias("tl"), (F.col("q_sid") % 2).alias("hap"), "t_str", "q_str")
    return X.genotypes(v, ends.select(F.col("sid").alias("t_name"), (F.col("q_sid") % 2).alias("hap"), F.col("ts").alias("b_bgn"), F.col("te").alias("b_end")))


def _families(spark, base) -> DataFrame:
    """Sequences with the key of their family: the smallest hash of their marks, which haplotypes of a locus share."""
    least = shimmers(C.sequences(spark, base), SKETCH).groupBy("sid").agg(F.min("hash").alias("family"))
    return C.sequences(spark, base).select("sid", F.upper("seq").alias("seq")).join(least, "sid")


@query
def consensus_kmer(spark, base):
    return K.consensus(_families(spark, base), "family", "kmer", 2, 31)


@query
def consensus_branches(spark, base):
    return K.consensus(_families(spark, base), "family", "branches")


@query
def consensus_guided(spark, base):
    return K.consensus(_families(spark, base), "family", "guided", 2)


@query
def consensus_sparse(spark, base):
    return K.consensus(_families(spark, base), "family", "sparse", 2)


@query
def delta_roundtrip(spark, base):
    """Each whole sequence coded against its family's first, or kept where they differ too much; restored must be the sequence."""
    rows = _families(spark, base).select("sid", "family", "seq")
    first = rows.groupBy("family").agg(F.min_by("seq", "sid").alias("base"))
    coded = A.delta_coded(rows.join(first, "family"), "base", "seq", ["sid", "family"])
    return coded.join(first, "family").select("sid", A.delta_restored(F.col("base"), F.col("coded"), F.col("raw")).alias("restored"))


_SKETCHED = f"""{_SKETCH}, nb AS (SELECT sid, ord, hash AS a, lead(hash) OVER w AS b, p, lead(p) OVER w AS np FROM sketch WINDOW w AS (PARTITION BY sid ORDER BY ord)),
pairs AS (SELECT sid, ord, least(a, b) AS h0, greatest(a, b) AS h1, p + 1 AS bgn, np + 1 AS end_pos, CAST(a > b AS INTEGER) AS orientation FROM nb WHERE b IS NOT NULL)"""

ORACLES |= {
    "shimmers_sketch": f"WITH {_SKETCH} SELECT sid, ord, hash, CAST(24 AS INTEGER) AS span, p AS pos, strand FROM sketch",
    "sketch_pair_sources": f"WITH {_SKETCHED}, cat AS (SELECT DISTINCT sid, name, upper(trim(source)) AS source FROM sequences) SELECT h0, h1, source, CAST(count(*) AS BIGINT) AS n FROM pairs JOIN cat USING (sid) GROUP BY h0, h1, source",
    "delta_roundtrip": f"WITH {_SKETCH} SELECT sid, upper(seq) AS restored FROM seqs WHERE sid IN (SELECT sid FROM sketch)",
}
