"""Registered queries; importing this package fills the registry."""

from evidex.plans import arm_queries, graph_queries, metric_queries, model_queries, retrieval_queries, risk_queries, stream_queries, text_queries  # noqa: F401
from evidex.plans.registry import ORACLES, QUERIES  # noqa: F401
