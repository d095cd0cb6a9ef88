"""Registered (Spark query, DuckDB oracle) pairs used by ``__spark_entry__.py``."""

from . import q_history, q_metrics, q_prep, q_profile, q_review, q_rules, q_task, q_train  # noqa: F401  (register)
from .registry import REGISTRY, oracle, spark_query

__all__ = ["REGISTRY", "oracle", "spark_query"]
