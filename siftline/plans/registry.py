"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from siftline.plans import ingest_queries, nested_queries, retrieval_queries, study_queries

MODULES = (retrieval_queries, study_queries, ingest_queries, nested_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = QUERIES["hybrid_topk"]
