"""All registered queries."""

from colloquy.plans import (  # noqa: F401
    dataset_queries,
    feature_queries,
    lineage_queries,
    metric_queries,
    rule_queries,
    state_queries,
    stream_queries,
    text_queries,
    validation_queries,
)
from colloquy.plans.registry import ORACLES, QUERIES  # noqa: F401
