"""Queries over the star-schema tables, one per operator or operator family."""

from . import basics, cohort, costs, episodes, panel, published, utilisation  # noqa: F401  (registration)
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
