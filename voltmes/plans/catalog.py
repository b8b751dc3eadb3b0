"""All registered queries."""

from voltmes.plans import cleaning, ingest, modelling, relational, statistics, validation  # noqa: F401
from voltmes.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
