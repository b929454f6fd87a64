"""Queries of the training-data operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.llm import heavy_hitters as L, leakage as K, mixing as M, residue as R, shared_spans as S, splitting as X
from strandframe.session import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return S.shared_spans(table(spark, base, "sequences", "sid", "seq"), "sid", "seq", length=100)


def p1_sizes(spark: SparkSession, base: str) -> DataFrame:
    return S.shared_sizes(p1_found(spark, base), "sid")


def _split(spark: SparkSession, base: str, strategy: str) -> DataFrame:
    seqs = table(spark, base, "sequences", "sid", "seq", "frg_start", "frg_n")
    items = seqs.select(F.col("sid").cast("long").alias("id"), F.length(F.regexp_replace("seq", "[^A-Za-z]+", "")).alias("size"), F.col("frg_start").alias("part_start"), F.col("frg_n").alias("part_n"))
    parts = table(spark, base, "fragments", "frg_id", "frg_len").select(F.col("frg_id").cast("long").alias("part_id"), F.col("frg_len").alias("length"))
    return X.split_oversized(items, parts, limit=2000, overlap=100, strategy=strategy).select(F.col("id").cast("int").alias("sid"), "bgn", "end_pos")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return _split(spark, base, "furthest")


def p2_bisected(spark: SparkSession, base: str) -> DataFrame:
    return _split(spark, base, "bisect")


def _marks(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "shimmers", "x", "y").where("x IS NOT NULL AND NOT (x = -1 AND y <=> -1)")
    return rows.select(F.expr("shiftrightunsigned(x, 8)").alias("hash"), F.coalesce(F.expr("shiftrightunsigned(y & 4294967295L, 1)"), F.lit(-1)).alias("pos"))


def _frequent(spark: SparkSession, base: str) -> DataFrame:
    found = L.frequent_items(_marks(spark, base), ["hash", "pos"], width=4000)
    return found.where("val >= 0").withColumn("kind", F.when(F.col("slot") == 0, "hash").otherwise("pos"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return L.above_share(_frequent(spark, base), 0.005).select("kind", "val")


def p6_counts(spark: SparkSession, base: str) -> DataFrame:
    """Values with their guaranteed count intervals."""
    return L.above_share(_frequent(spark, base), 0.005).select("kind", "val", "low", "high", "total")


def p6_bounds(spark: SparkSession, base: str) -> DataFrame:
    """The frequent values with the number of counted rows, and whether their true count lies in the interval."""
    found = L.above_share(_frequent(spark, base), 0.005)
    rows = _marks(spark, base)
    each = rows.select(F.explode(F.array(F.struct(F.lit("hash").alias("kind"), F.col("hash").alias("val")), F.struct(F.lit("pos").alias("kind"), F.col("pos").alias("val")))).alias("v")).select("v.*")
    true = each.join(found.select("kind", "val"), ["kind", "val"], "left_semi").groupBy("kind", "val").agg(F.count("*").alias("n"))
    return found.join(true, ["kind", "val"]).select("kind", "val", "total", ((F.col("low") <= F.col("n")) & (F.col("n") <= F.col("high"))).alias("holds"))


def _leaks(spark: SparkSession, base: str, **how) -> DataFrame:
    docs, items = table(spark, base, "documents", "doc_id", "text"), table(spark, base, "eval_items", "item_id", "text")
    return K.leaked_items(docs, "doc_id", "text", items, "item_id", "text", passage=12, **how)


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Rare seeds give the candidates, the longest run in their alignment decides: 12 words, or the whole item if it has fewer."""
    return _leaks(spark, base).where("run >= least(12, item_words)").select("doc_id", "item_id")


def p8_edited(spark: SparkSession, base: str) -> DataFrame:
    """Documents with at least half of an item in alignment, however edited, as long as five successive words are left."""
    return _leaks(spark, base, least=0.5, rare=False).select("doc_id", "item_id", "run", "score", F.round("share", 4).alias("share"))


def _mix(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, base, "documents", "doc_id", "text", "source", "lang", "tags")
    lang, topic = F.lower(F.trim("lang")), F.lower(F.trim(F.split("tags", ",")[0]))
    return M.mix_sources(docs, table(spark, base, "mix_targets"), "doc_id", "text", "source", lang, topic)


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[0]


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[1]


def p9_margins(spark: SparkSession, base: str) -> DataFrame:
    """The shares of sources, languages and topics that were asked for and that were reached."""
    return _mix(spark, base)[2].select("margin", "value", F.round("wanted_share", 6).alias("wanted_share"), F.round("reached_share", 6).alias("reached_share"))


def p9_checks(spark: SparkSession, base: str) -> DataFrame:
    """What the mix must keep: sources within 1 %, languages and topics within 2 % of their shares, caps, no source without a target."""
    mix, report, margins = _mix(spark, base)
    most = {"source": 0.01, "language": 0.02, "topic": 0.02}
    far = margins.groupBy("margin").agg(F.max(F.abs(F.col("wanted_share") - F.col("reached_share"))).alias("x"))
    bound = F.create_map(*(F.lit(v) for kv in most.items() for v in kv))
    far = far.select(F.concat("margin", F.lit("s")).alias("check"), (F.col("x") <= bound[F.col("margin")]).alias("holds"))
    caps = report.agg(F.count_if(F.col("most_copies") > F.col("max_repeats")).alias("n")).select(F.lit("caps").alias("check"), (F.col("n") == 0).alias("holds"))
    others = mix.join(report.select("source"), "source", "left_anti").agg(F.count("*").alias("n")).select(F.lit("targets").alias("check"), (F.col("n") == 0).alias("holds"))
    return far.unionByName(caps).unionByName(others)


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return R.find_residue(table(spark, base, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


QUERIES = {f.__name__: f for f in (p1_found, p1_sizes, p2_found, p2_bisected, p6_found, p6_counts, p6_bounds, p8_found, p8_edited, p9_mix, p9_shares, p9_margins, p9_checks, p10_found)}

_SPANS = """WITH s AS (SELECT DISTINCT sid, upper(seq) AS seq FROM sequences WHERE seq IS NOT NULL AND length(seq) >= 100),
w AS (SELECT sid, i, substr(seq, CAST(i AS INTEGER) + 1, 100) AS t FROM s, LATERAL (SELECT unnest(range(length(s.seq) - 99)) AS i)),
h AS (SELECT sid, i, md5_number(t) AS h FROM w WHERE NOT regexp_matches(t, '[^ACGT]')),
c AS (SELECT h FROM h GROUP BY h HAVING min(sid) <> max(sid)),
m AS (SELECT sid, i, lag(i) OVER (PARTITION BY sid ORDER BY i) AS p FROM h WHERE h IN (SELECT h FROM c)),
g AS (SELECT sid, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM m),
f AS (SELECT sid, CAST(min(i) AS BIGINT) AS bgn, CAST(max(i) + 100 AS BIGINT) AS end_pos FROM g GROUP BY sid, k)"""

_COUNTED = """r AS (SELECT (CAST(x AS HUGEINT) + CASE WHEN x < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END) // 256 AS hash, (y & 4294967295) >> 1 AS pos
  FROM shimmers WHERE x IS NOT NULL AND NOT (x = -1 AND y IS NOT DISTINCT FROM -1)), n AS (SELECT count(*) AS n FROM r)"""

# The folded forms of letters that occur: full-width digits and letters, two ligatures. Unseen letters are dropped.
_WIDE = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF41 + i) for i in range(26)) + "".join(chr(0xFF21 + i) for i in range(26))
_PLAIN = "0123456789" + "abcdefghijklmnopqrstuvwxyz" * 2
_UNSEEN = "[\u00ad\u200b-\u200f\u2060-\u206f\ufeff]"
_TAGS = "<!--.*?-->|</?[A-Za-z][A-Za-z0-9]*(?:\\s[^<>]*)?/?>"


def _words(text: str) -> str:
    bare = f"regexp_replace(regexp_replace({text}, '{_TAGS}', ' ', 'gs'), '{_UNSEEN}', '', 'g')"
    return f"regexp_extract_all(lower(replace(replace(translate({bare}, '{_WIDE}', '{_PLAIN}'), '\ufb01', 'fi'), '\ufb02', 'fl')), '[\\p{{L}}\\p{{N}}]+')"


ORACLES = {
    "p1_found": f"{_SPANS} SELECT sid, bgn, end_pos FROM f",
    "p1_sizes": f"{_SPANS} SELECT sid, count(*) AS n_spans, CAST(sum(end_pos - bgn) AS BIGINT) AS shared_bases FROM f GROUP BY sid",
    "p2_found": """
WITH RECURSIVE s AS (SELECT DISTINCT sid, length(regexp_replace(seq, '[^A-Za-z]', '', 'g')) AS size, frg_start, frg_n FROM sequences),
big AS (SELECT * FROM s WHERE size > 2000), f AS (SELECT DISTINCT frg_id, frg_len FROM fragments),
b AS (SELECT sid, sum(frg_len) OVER (PARTITION BY sid ORDER BY frg_id) AS stop_at FROM big JOIN f ON frg_id >= frg_start AND frg_id < frg_start + frg_n),
e AS (SELECT sid, list(DISTINCT stop_at) AS ats FROM b GROUP BY sid),
i AS (SELECT big.sid, size, coalesce(ats, []) AS ats FROM big LEFT JOIN e USING (sid)),
p AS (
  SELECT sid, size, ats, 0::BIGINT AS bgn, CASE WHEN size <= 2000 THEN size ELSE coalesce(list_max(list_filter(ats, lambda x: x > 0 AND x <= 2000)), 2000) END::BIGINT AS end_pos FROM i
  UNION ALL
  SELECT sid, size, ats, nxt, CASE WHEN size <= nxt + 2000 THEN size ELSE coalesce(list_max(list_filter(ats, lambda x: x > end_pos AND x <= nxt + 2000)), nxt + 2000) END::BIGINT FROM (SELECT *, end_pos - 100 AS nxt FROM p WHERE end_pos < size))
SELECT sid, bgn, end_pos FROM p""",
    "p6_found": f"""WITH {_COUNTED}
SELECT 'hash' AS kind, CAST(hash AS BIGINT) AS val FROM r, n GROUP BY hash, n HAVING count(*) >= 0.005 * n
UNION ALL SELECT 'pos', CAST(pos AS BIGINT) FROM r, n WHERE pos IS NOT NULL GROUP BY pos, n HAVING count(*) >= 0.005 * n""",
    "p6_bounds": f"""WITH {_COUNTED}
SELECT 'hash' AS kind, CAST(hash AS BIGINT) AS val, n AS total, true AS holds FROM r, n GROUP BY hash, n HAVING count(*) >= 0.005 * n
UNION ALL SELECT 'pos', CAST(pos AS BIGINT), n, true FROM r, n WHERE pos IS NOT NULL GROUP BY pos, n HAVING count(*) >= 0.005 * n""",
    "p9_checks": "SELECT * FROM (VALUES ('sources', true), ('languages', true), ('topics', true), ('caps', true), ('targets', true)) AS t(\"check\", holds)",
    "p8_found": f"""
WITH d AS (SELECT DISTINCT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_words("text")} AS w FROM eval_items WHERE text IS NOT NULL),
s AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g)""",
}
