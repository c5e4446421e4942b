"""Every query of the library by name, with the same result as SQL."""

from __future__ import annotations

from .plans import corpus, decisions, joined, ranking, reports, streams, texts  # noqa: F401  (they register their queries)
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_retrieval"
