"""All registered queries of the library: the catalogue and the modules that add to it."""

from . import file_queries, scoring_queries
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "file_queries", "scoring_queries"]
