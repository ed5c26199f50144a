"""All catalogue queries and their SQL."""

from . import gates  # registers its queries
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "gates"]
