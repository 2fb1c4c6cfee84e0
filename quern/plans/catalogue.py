"""All queries of the engine by name, with SQL that gives the same rows."""

from __future__ import annotations

from quern.plans import answers, corpus, fusion, graph, lookups, measures, papers, profiles, retrieval, routing, scoring, stores, texts

_PARTS = (retrieval, corpus, papers, lookups, graph, answers, measures, stores, texts, routing, fusion, scoring, profiles)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
