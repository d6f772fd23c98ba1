"""Queries of the engine's operators, each with its SQL twin where there is one."""

from . import comparison_queries, context_queries, evaluation_queries, family_queries, feature_queries, flagship, frame_queries, generator_queries, knob_queries, metric_queries, model_queries, panel_queries, readout_queries, relational_queries, streaming_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "comparison_queries", "context_queries", "evaluation_queries", "family_queries", "feature_queries", "flagship", "frame_queries", "generator_queries", "knob_queries", "metric_queries", "model_queries", "panel_queries", "readout_queries", "relational_queries", "streaming_queries"]
