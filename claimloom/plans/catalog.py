"""The query catalogue: every operator on the tables it can be shown on."""

from __future__ import annotations

from claimloom.plans import bundle, claims, details, documents, evaluation, functions, streams, verification
from claimloom.plans.registry import ORACLE, QUERIES

PARTS = (claims, documents, functions, verification, evaluation, streams, details, bundle)

__all__ = ["ORACLE", "PARTS", "QUERIES"]
