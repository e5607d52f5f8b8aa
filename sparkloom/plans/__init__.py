"""All registered queries."""

from sparkloom.plans import context_queries, etl_queries, metric_queries, ranking_queries, retrieval_queries, table_queries, text_queries  # noqa: F401
from sparkloom.plans.registry import QUERIES, SQL  # noqa: F401
