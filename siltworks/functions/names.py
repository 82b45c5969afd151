"""Column-name rules. Names are metadata, so this runs on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable

EMPTY_NAME = "col"


def standard_name(name: str) -> str:
    """Lower case; every run of other characters than a-z and 0-9 is one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def standard_names(names: Iterable[str]) -> list[str]:
    """Standard names, made unique with ``_1``, ``_2``, ... in column order."""
    taken: set[str] = set()
    result = []
    for name in names:
        base = standard_name(name) or EMPTY_NAME
        unique, suffix = base, 0
        while unique in taken:
            suffix += 1
            unique = f"{base}_{suffix}"
        taken.add(unique)
        result.append(unique)
    return result


def quoted(name: str) -> str:
    """A name that may hold dots, spaces or backticks, safe for ``col`` and SQL text."""
    return "`" + name.replace("`", "``") + "`"


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for helper columns: the wanted ones, lengthened until no column has them, upper and lower case alike."""
    used = {name.lower() for name in taken}
    result = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        result.append(name)
    return result
