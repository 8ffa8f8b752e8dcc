"""Queries on snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.snapshot_changes import snapshot_changes
from ..sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes between consecutive snapshots of each repository, over all rows of ``snapshot_nodes``."""
    return snapshot_changes(table(spark, folder, "snapshot_nodes"), table(spark, folder, "graph_snapshots"))


QUERIES = {"p5_found": p5_found}

ORACLES = {
    "p5_found": """
WITH o AS (
  SELECT repository_id, commit_sha,
         row_number() OVER (PARTITION BY repository_id ORDER BY min(created_at), commit_sha) AS k
  FROM graph_snapshots
  WHERE repository_id IS NOT NULL AND commit_sha IS NOT NULL AND created_at IS NOT NULL
  GROUP BY repository_id, commit_sha),
n AS (
  SELECT commit_sha, id, arg_max(lower(trim(coalesce(hash, ''))), seq) AS h
  FROM snapshot_nodes WHERE id IS NOT NULL AND commit_sha IS NOT NULL GROUP BY commit_sha, id),
x AS (SELECT repository_id, k, id, h FROM n JOIN o USING (commit_sha)),
f AS (
  SELECT x.repository_id, x.k, x.id,
         CASE WHEN p.id IS NULL THEN 'added' WHEN p.h <> x.h THEN 'changed' END AS change_kind
  FROM x LEFT JOIN x p ON p.repository_id = x.repository_id AND p.k = x.k - 1 AND p.id = x.id
  WHERE x.k > 1
  UNION ALL
  SELECT x.repository_id, x.k + 1, x.id, 'removed'
  FROM x LEFT JOIN x p ON p.repository_id = x.repository_id AND p.k = x.k + 1 AND p.id = x.id
  WHERE p.id IS NULL AND EXISTS (SELECT 1 FROM o WHERE o.repository_id = x.repository_id AND o.k = x.k + 1))
SELECT commit_sha, id, change_kind FROM f JOIN o USING (repository_id, k) WHERE change_kind IS NOT NULL
""",
}
