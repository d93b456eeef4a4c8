"""The registered queries: each operator on the driver's tables, with the same in DuckDB's SQL beside it."""

from skein.catalog import core, more, reads, texts, upserts  # noqa: F401
from skein.catalog.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
