"""Pieces of SQL that the twins of several queries share."""

from __future__ import annotations

from ..schema import DEPENDENCIES

DEPENDENCY_LIST = ", ".join(f"'{t}'" for t in DEPENDENCIES)

#: n, e: one row for each node and edge; d: distinct dependency pairs; s: start nodes of searches.
GRAPH = f"""
n AS (SELECT * FROM code_nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1),
e AS (SELECT * FROM code_edges WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1),
d AS (SELECT DISTINCT source AS src, target AS dst FROM code_edges
      WHERE type IN ({DEPENDENCY_LIST}) AND coalesce(resolution, '') <> 'unresolved' AND source IS NOT NULL AND target IS NOT NULL),
s AS (SELECT DISTINCT id FROM code_nodes WHERE seq % 100 = 0 AND id IS NOT NULL)
"""


def graph_sql(body: str, recursive: str = "") -> str:
    """A statement over the common tables above; ``recursive`` holds further, possibly recursive ones."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH}{', ' + recursive if recursive else ''} {body}"
