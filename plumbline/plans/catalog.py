"""All registered queries."""

from plumbline.plans import (  # noqa: F401
    contract_queries, metric_queries, model_queries, profile_queries, rule_queries, stats_queries,
)
from plumbline.plans.registry import ORACLES, QUERIES  # noqa: F401
