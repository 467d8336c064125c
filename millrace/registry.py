"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from millrace.operators import communities, corpus, entities, feedback, finance, graph, knowledge, ledger, linked_data, passages, pseudonyms, quality, ranking, reconcile, retrieval, search_index, selection, series, sessions, store, subgraphs, toolbox, tools, vectors

FAMILIES = (ledger, finance, series, quality, corpus, passages, retrieval, ranking, graph, knowledge, sessions, feedback, toolbox, communities, vectors, entities, reconcile, linked_data, pseudonyms, search_index, selection, subgraphs, store, tools)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in FAMILIES for name, sql in family.ORACLE_SQL.items()}
