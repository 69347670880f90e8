"""Registered queries of the analytics operators."""

from emberlog.plans import fights, names, reading  # noqa: F401  their queries register themselves
from emberlog.plans.queries import QUERIES, SQL, flagship

__all__ = ["QUERIES", "SQL", "flagship"]
