"""All registered queries."""

from spanframe.plans import interval_queries, model_queries, scoring_queries, summary_queries, table_queries  # noqa: F401
from spanframe.plans.registry import REGISTRY, oracle_text  # noqa: F401
