"""All core queries and their SQL twins."""

from __future__ import annotations

from . import corpus, graphs, indexing, snapshots

MODULES = (snapshots, graphs, corpus, indexing)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
