"""All queries of the engine."""

from . import annotation_queries, decode_queries, sequence_queries, short_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
