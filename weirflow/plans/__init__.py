"""Named queries and their oracles."""

from weirflow.plans import (  # noqa: F401
    distribution_queries,
    flow_queries,
    heavy_queries,
    learning_queries,
    model_queries,
    proof_queries,
    source_queries,
)
from weirflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
