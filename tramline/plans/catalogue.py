"""All registered queries of the library."""

from __future__ import annotations

from . import queries_files, queries_more  # noqa: F401  they register themselves
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
