"""Imports every query module so that it registers its queries."""

from motionframe.plans import (  # noqa: F401
    collection_queries,
    feature_queries,
    metric_queries,
    model_queries,
    quality_queries,
    statistics_queries,
    window_queries,
)
from motionframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
