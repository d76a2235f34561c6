"""Queries over the given tables, each with SQL that must give the same rows."""

from catalog import batch, frames, signals, storage, text, tokens  # noqa: F401
from catalog.registry import ORACLE, QUERIES  # noqa: F401
