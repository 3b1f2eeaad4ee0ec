"""All queries of the catalogue, from the modules that register them."""

from grainery.plans import headings, writes  # noqa: F401  they register their queries
from grainery.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
