"""Queries of the referential-integrity operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.references import orphan_references, orphan_report


def p3_found(s: SparkSession, d: str) -> DataFrame:
    files, base = s.read.parquet(f"{d}/files.parquet"), s.read.parquet(f"{d}/base_types.parquet")
    return orphan_references(files, base).select("file_id", "field", "target").distinct()


def p3_report(s: SparkSession, d: str) -> DataFrame:
    return orphan_report(s.read.parquet(f"{d}/files.parquet"), s.read.parquet(f"{d}/base_types.parquet")).select("field", F.col("month"), "n_refs", "n_orphans")


_REFS = r"""
raw AS (SELECT file_id, repo, indexed_at, 'extends' AS field, extends AS raw FROM files
  UNION ALL SELECT file_id, repo, indexed_at, 'instances', unnest(instances) FROM files
  UNION ALL SELECT file_id, repo, indexed_at, 'attached_script', attached_script FROM files),
bare AS (SELECT *, regexp_replace(regexp_replace(raw, '^[\s"]+|[\s"]+$', '', 'g'), '^res://', '') AS b FROM raw WHERE raw IS NOT NULL),
refs AS (SELECT DISTINCT file_id, repo, indexed_at, field, CASE WHEN contains(b, '/') THEN b
    ELSE trim(regexp_replace(regexp_replace(b, '[<\[].*$', '', 's'), '^.*\.', '', 's')) END AS target, contains(b, '/') AS is_path FROM bare),
real AS (SELECT * FROM refs WHERE target <> '' AND NOT (field = 'extends' AND NOT is_path AND target IN (SELECT type_name FROM base_types WHERE type_name IS NOT NULL))),
bad AS (SELECT * FROM real r WHERE NOT EXISTS (SELECT 1 FROM files p WHERE p.repo = r.repo AND (CASE WHEN r.is_path THEN p.path ELSE p.class_name END) = r.target
    AND p.indexed_at <= r.indexed_at AND (p.removed_at IS NULL OR p.removed_at > r.indexed_at)))
"""
ORACLE = {
    "p3_found": f"WITH {_REFS} SELECT DISTINCT file_id, field, target FROM bad",
    "p3_report": f"""WITH {_REFS} SELECT field, strftime(indexed_at, '%Y-%m') AS month, count(*) AS n_refs,
  (SELECT count(*) FROM bad b WHERE b.field = real.field AND strftime(b.indexed_at, '%Y-%m') = strftime(real.indexed_at, '%Y-%m')) AS n_orphans FROM real GROUP BY ALL""",
}
QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
