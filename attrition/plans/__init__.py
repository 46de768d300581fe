"""Registered queries (Spark plans) and their DuckDB oracles."""

from .inputs import Inputs, finish  # noqa: F401
from .registry import query, registered, runner  # noqa: F401
