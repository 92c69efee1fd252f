"""All registered queries: importing a module of queries registers them."""

from scoreloom.plans import queries_analytics, queries_answers, queries_checks, queries_runs, queries_sampling, queries_scores, queries_sources, queries_text, queries_vectors  # noqa: F401
from scoreloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
