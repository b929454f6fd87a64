"""Queries of the general data problems (3, 4, 5 and 7) over the test tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.functions.columns import trimmed
from strandframe.operators import hierarchy as H, packed as P, rejects as R
from strandframe.operators.intervals_merge import merge_intervals
from strandframe.session import stored, table


def _feature_ids(records: DataFrame) -> DataFrame:
    """(node, id, parents) of each delivered row, from its packed attributes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parents = [], []
            for text in batch.column(1).to_pylist():
                values = P.quoted_segment(text)
                ids.append(next((v.strip() for t, _, v in values if t == "ID"), None))
                parents.append([v.strip() for t, _, v in values if t == "Parent"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.string()), pa.array(parents, pa.list_(pa.string()))], ["node", "id", "parents"])

    src = records.select(F.col("rec_id").alias("node"), "attributes").where("node IS NOT NULL")
    return src.mapInArrow(run, "node long, id string, parents array<string>")


def feature_links(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links (child, parent) of the features: Parent attributes and gff_children together, by record id.

    Rows delivered twice give nodes and links twice, which the operator takes as one.
    """
    records = stored(_feature_ids(table(spark, base, "gff_records", "rec_id", "attributes")))
    ids = records.select(trimmed("id").alias("id"), "node").where("id IS NOT NULL")
    by_attribute = records.select(F.col("node").alias("child"), F.explode("parents").alias("pid")).withColumn("pid", trimmed("pid"))
    listed = table(spark, base, "gff_children", "parent_id", "child_id").select(trimmed("parent_id").alias("pid"), trimmed("child_id").alias("id"))
    by_list = listed.where("pid IS NOT NULL").join(ids, "id").select(F.col("node").alias("child"), "pid")
    owner = ids.groupBy("id").agg(F.min("node").alias("parent")).withColumnRenamed("id", "pid")
    links = by_attribute.unionByName(by_list).where("pid IS NOT NULL").join(owner, "pid").select("child", "parent")
    return records.select("node"), links


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    laid = H.hierarchy(*feature_links(spark, base))
    return laid.select(F.col("node").alias("rec_id"), F.col("root").alias("root_rec_id"), "depth")


def p3_paths(spark: SparkSession, base: str) -> DataFrame:
    laid = H.hierarchy(*feature_links(spark, base))
    return H.paths(laid).select(F.col("node").alias("rec_id"), F.col("root").alias("root_rec_id"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p3_descendants(spark: SparkSession, base: str) -> DataFrame:
    laid = H.hierarchy(*feature_links(spark, base))
    return H.descendants(laid).select(F.col("ancestor").alias("rec_id"), F.col("node").alias("descendant_rec_id"), "distance")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Values by the rules of quoting, which leave a dictionary nothing to decide; ``p4_protected`` is the query with one."""
    records = table(spark, base, "gff_records", "rec_id", "attributes")
    return P.split_packed(records, "rec_id", "attributes").where("tag IS NOT NULL")


def p4_protected(spark: SparkSession, base: str) -> DataFrame:
    """As p4_found, but values known from quoted places stay whole where their quotes are missing."""
    records = table(spark, base, "gff_records", "rec_id", "attributes")
    return P.split_packed(records, "rec_id", "attributes", P.learned_values(records, "attributes"), protect=True)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    bed = table(spark, base, "bundle_bed", "ctg", "bgn", "end_pos").withColumn("ctg", F.trim("ctg"))
    return merge_intervals(bed, "ctg", "bgn", "end_pos").withColumnRenamed("entity", "ctg")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "gff_lines", "line_id", "line")
    return R.load_with_rejects(lines, "line_id", "line", only="rejected").select("line_id", "reason")


def p7_valid(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "gff_lines", "line_id", "line")
    return R.load_with_rejects(lines, "line_id", "line", only="valid").drop("reason")


QUERIES = {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p4_found, p4_protected, p5_found, p7_found, p7_valid)}

_QUOTED, _DECIMAL = R.WELL_QUOTED.replace("'", "''"), R.DECIMAL.replace("'", "''")
_LINES = "SELECT DISTINCT line_id, string_split(text, chr(9)) AS c FROM (SELECT line_id, CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS text FROM gff_lines) WHERE length(text) > 0 AND NOT starts_with(text, '#')"
_JUDGED = f"""WITH l AS ({_LINES}), judged AS (SELECT line_id, c, CASE WHEN len(c) <> 9 THEN 'columns'
  WHEN NOT regexp_full_match(c[9], '{_QUOTED}', 's') THEN 'quoting'
  WHEN NOT coalesce(regexp_full_match(c[4], '[0-9]+') AND regexp_full_match(c[5], '[0-9]+') AND TRY_CAST(c[4] AS HUGEINT) BETWEEN 1 AND TRY_CAST(c[5] AS HUGEINT)
    AND TRY_CAST(c[5] AS HUGEINT) < 4294967296 AND (c[6] = '.' OR regexp_full_match(c[6], '{_DECIMAL}') AND isfinite(TRY_CAST(c[6] AS DOUBLE)))
    AND c[8] IN ('.', '0', '1', '2'), false) THEN 'value' END AS reason FROM l)"""

# a literal is taken whole where it is closed; an unclosed quote is an ordinary letter
_PARTS = "(?:\"(?:[^\"]|\"\")*\"|[^{}])+"
_VALUES = f"""rec AS (SELECT DISTINCT rec_id, attributes FROM gff_records WHERE attributes IS NOT NULL),
fld AS (SELECT rec_id, attributes, unnest(f) AS field, generate_subscripts(f, 1) AS fi FROM (SELECT *, regexp_extract_all(attributes, '{_PARTS.format(";")}') AS f FROM rec)),
seg AS (SELECT rec_id, attributes, fi, field, trim(unnest(s), ' ') AS seg, generate_subscripts(s, 1) AS si FROM (SELECT *, regexp_extract_all(field, '{_PARTS.format(",|")}') AS s FROM fld)),
led AS (SELECT *, strpos(seg, '"') AS q, strpos(seg, '=') AS e, si = 1 AND NOT regexp_matches(field, '^[,|]') AS lead FROM seg),
own AS (SELECT *, CASE WHEN lead AND e > 0 AND (q = 0 OR e < q) THEN nullif(trim(left(seg, e - 1), ' '), '') WHEN lead AND q > 1 AND seg[q - 1] = ' ' THEN trim(left(seg, q - 1), ' ') END AS own FROM led),
val AS (SELECT rec_id, fi, si, last_value(own IGNORE NULLS) OVER (PARTITION BY rec_id, attributes ORDER BY fi, si ROWS UNBOUNDED PRECEDING) AS tag,
  trim(CASE WHEN own IS NULL THEN seg WHEN e > 0 AND (q = 0 OR e < q) THEN substr(seg, e + 1) ELSE substr(seg, q) END, ' ') AS t FROM own),
lit AS (SELECT rec_id, fi, si, tag, CASE WHEN length(t) > 1 AND starts_with(t, '"') AND ends_with(t, '"') THEN replace(substr(t, 2, length(t) - 2), '""', '"') ELSE t END AS val FROM val),
p4 AS (SELECT rec_id, tag, CAST(row_number() OVER (PARTITION BY rec_id, tag ORDER BY fi, si) AS INTEGER) AS pos, val FROM lit WHERE val <> '')"""
_TREES = f"""WITH RECURSIVE {_VALUES},
ids AS (SELECT rec_id AS node, nullif(trim(arg_min(val, pos)), '') AS id FROM p4 WHERE tag = 'ID' GROUP BY rec_id),
owner AS (SELECT id, min(node) AS parent FROM ids WHERE id IS NOT NULL GROUP BY id),
named AS (SELECT rec_id AS child, nullif(trim(val), '') AS pid FROM p4 WHERE tag = 'Parent' UNION SELECT i.node, nullif(trim(c.parent_id), '') FROM gff_children c JOIN ids i ON i.id = nullif(trim(c.child_id), '')),
links AS (SELECT DISTINCT child, parent FROM named JOIN owner ON pid = id),
above AS (SELECT child AS node, parent AS anc FROM links UNION SELECT a.node, l.parent FROM above a JOIN links l ON l.child = a.anc),
caught AS (SELECT DISTINCT node FROM above WHERE anc IN (SELECT node FROM above WHERE node = anc)),
nodes AS (SELECT DISTINCT rec_id AS node FROM gff_records WHERE rec_id IS NOT NULL),
single AS (SELECT child, min(parent) AS up FROM links WHERE child NOT IN (SELECT node FROM caught) GROUP BY child),
way AS (SELECT node, node AS top, 0::BIGINT AS d FROM nodes WHERE node NOT IN (SELECT node FROM caught) UNION ALL SELECT w.node, s.up, w.d + 1 FROM way w JOIN single s ON s.child = w.top)"""

ORACLES = {
    "p3_found": f"{_TREES} SELECT node AS rec_id, arg_max(top, d) AS root_rec_id, max(d) AS depth FROM way GROUP BY node UNION ALL SELECT node, -1, -1 FROM caught",
    "p3_paths": f"{_TREES} SELECT node AS rec_id, arg_max(top, d) AS root_rec_id, max(d) AS depth, string_agg(CAST(top AS VARCHAR), '/' ORDER BY d DESC) AS path FROM way GROUP BY node UNION ALL SELECT node, -1, -1, NULL FROM caught",
    "p3_descendants": f"{_TREES} SELECT top AS rec_id, node AS descendant_rec_id, d AS distance FROM way WHERE d > 0",
    "p4_found": f"WITH {_VALUES} SELECT * FROM p4 WHERE tag IS NOT NULL",
    # no known value stands unquoted in this table, so the rules of quoting give the same rows
    "p4_protected": f"WITH {_VALUES} SELECT * FROM p4",
    "p5_found": """
WITH s AS (SELECT trim(ctg) AS ctg, CAST(bgn AS BIGINT) AS bgn, CAST(end_pos AS BIGINT) AS e FROM bundle_bed WHERE ctg IS NOT NULL AND bgn < end_pos),
m AS (SELECT *, max(e) OVER (PARTITION BY ctg ORDER BY bgn, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR bgn > reach THEN 1 ELSE 0 END) OVER (PARTITION BY ctg ORDER BY bgn, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
i AS (SELECT ctg, min(bgn) AS bgn, max(e) AS e FROM g GROUP BY ctg, k),
n AS (SELECT *, lead(bgn) OVER (PARTITION BY ctg ORDER BY bgn) AS nxt FROM i)
SELECT ctg, 'merged' AS kind, bgn, e AS end_pos FROM n UNION ALL SELECT ctg, 'gap', e, nxt FROM n WHERE nxt IS NOT NULL""",
    "p7_found": f"{_JUDGED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p7_valid": f"""{_JUDGED} SELECT line_id, nullif(c[1], '') AS seqid, nullif(c[2], '') AS source, nullif(c[3], '') AS type_name, CAST(c[4] AS BIGINT) AS bgn, CAST(c[5] AS BIGINT) AS end_pos,
  TRY_CAST(c[6] AS DOUBLE) + 0.0 AS score, nullif(c[7], '') AS strand, TRY_CAST(c[8] AS INTEGER) AS phase, nullif(c[9], '') AS attributes FROM judged WHERE reason IS NULL""",
}
