"""Registered queries and the SQL that states the same result."""

from quillvec.queries import cleaning, loading, retrieval, statistics, texts, vectors  # noqa: F401
from quillvec.queries.registry import ORACLES, QUERIES  # noqa: F401
