"""All registered queries and their SQL."""

from docflow.plans import leaf_queries, link_queries, log_queries, process_queries  # noqa: F401 - registers their queries
from docflow.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
