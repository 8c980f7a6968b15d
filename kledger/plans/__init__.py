"""Named queries. Importing this package fills the registry."""

from kledger.plans import core, evals, fn, know, ret, stream  # noqa: F401
from kledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
