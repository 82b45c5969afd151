"""Every operator as a named query over the given tables, with the SQL it must equal."""

from siltworks.registry import (  # noqa: F401  (importing a module registers its queries)
    cleaning,
    contracts,
    jobs,
    quality,
    relations,
    scans,
)
from siltworks.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
