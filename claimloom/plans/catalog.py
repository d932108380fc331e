"""All queries of the library by name, with the SQL that they must agree with."""

from __future__ import annotations

from claimloom.plans import boundaries, cleaning, extraction, formats, learners, learning, lexicons, nearest, relations, selection, serving, training  # noqa: F401
from claimloom.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
