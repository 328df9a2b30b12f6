"""All queries by name, and their SQL."""

from __future__ import annotations

from . import counts, functions, lists, merges, normalizers, relations, streams  # noqa: F401
from .analogues import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
