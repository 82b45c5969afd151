"""Data contracts: which columns a table must have and what each may hold."""

from siltworks.contracts.model import Check, Contract, Field
from siltworks.contracts.validate import (
    ContractError,
    accepted,
    annotate,
    enforce,
    error_counts,
    rejected,
)

__all__ = [
    "Check",
    "Contract",
    "ContractError",
    "Field",
    "accepted",
    "annotate",
    "enforce",
    "error_counts",
    "rejected",
]
