"""Registered queries and their SQL."""

from __future__ import annotations

from tessella.plans.oracles import ORACLES
from tessella.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
