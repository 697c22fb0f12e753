"""All registered queries."""

from framestride.plans import audit_queries, feature_queries, hand_queries, object_queries, series_queries, source_queries, stream_queries, training_queries, two_hand_queries  # noqa: F401
from framestride.plans.registry import ORACLES, QUERIES  # noqa: F401
