"""All named queries over the tables, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import candidates, checks, citations, cover, documents, evidence, flow, manifests, records, retrieval, review, scoring, sources, tables, training, vectors, verify, windows  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "bm25_search"
