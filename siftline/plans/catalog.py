"""All named queries."""
from . import (  # noqa: F401  (importing registers the queries)
    dataset_queries,
    findings_queries,
    graph_queries,
    learning_queries,
    scan_queries,
    similarity_queries,
    stream_queries,
)
from .registry import CHECK_SQL, QUERIES  # noqa: F401
