"""The queries of the library; importing this package registers them."""

from tidelog.plans import admin_queries, handler_queries, log_queries, state_queries, stream_queries, text_queries  # noqa: F401
from tidelog.plans.registry import RUNS, SQL


def queries():
    return dict(RUNS)


def oracle_sql():
    return dict(SQL)
