"""All registered queries of the library."""

from __future__ import annotations

from quire.plans import correction_queries, detector_queries, export_queries, span_queries, structure_queries, survey_queries, word_queries  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
