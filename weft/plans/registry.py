"""All registered queries of the library, by name."""

from __future__ import annotations

from weft.plans import community_queries, dependency_queries, gate_queries, graph_queries, path_queries, profile_queries, record_queries, run_queries, scalar_queries, scanner_queries, source_queries, task_queries, trajectory_queries, vector_queries

MODULES = (graph_queries, vector_queries, scalar_queries, trajectory_queries, source_queries, record_queries, task_queries, gate_queries, community_queries, path_queries, scanner_queries, profile_queries, run_queries, dependency_queries)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict:
    return {name: q for m in MODULES for name, q in m.oracle_sql().items()}
