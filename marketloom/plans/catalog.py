"""Imports every query module so that the registry is complete."""
from . import (  # noqa: F401
    graph_queries, news_queries, panel, pattern_queries, scalar_queries, signal_queries, source_queries,
    stream_queries)
from .registry import ABOUT, CATALOG, spark_queries, sql_texts  # noqa: F401
