"""Quality checks and profiles; each reports rows, none changes the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.names import quoted
from siltworks.functions.numbers import missing, nan_as_null
from siltworks.operators.columns import unfold
from siltworks.operators.statistics import column_types

BOUNDS = ("min", "max")


def range_checks(df: DataFrame, checks: dict[str, dict[str, object]]) -> DataFrame:
    """(column, bound, limit, violations) for ``{"age": {"min": 0, "max": 120}}``.

    Bounds are inclusive, null passes. All checks share one pass.
    """
    aggregates, rows = [], []
    for name, bounds in checks.items():
        unknown = set(bounds) - set(BOUNDS)
        if unknown:
            raise ValueError(f"column {name}: unknown checks {sorted(unknown)}, use {BOUNDS}")
        c = F.col(quoted(name))
        for bound, limit in bounds.items():
            key = f"v{len(rows)}"
            violated = c < F.lit(limit) if bound == "min" else c > F.lit(limit)
            aggregates.append(F.count_if(violated).alias(key))
            rows.append({
                "column": F.lit(name),
                "bound": F.lit(bound),
                "limit": F.lit(str(limit)),
                "violations": F.col(key),
            })
    if not rows:
        raise ValueError("no checks given")
    return unfold(df.agg(*aggregates), rows)


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose key has no parent; a null key has none."""
    parents = parent.select(F.col(quoted(key)).alias("_parent"))
    return child.join(parents, F.col(quoted(column)) == F.col("_parent"), "left_anti")


def orphan_count(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(column, violations). Keys are counted first, so the join sees each key once."""
    keys = child.groupBy(F.col(quoted(column)).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    parents = parent.select(F.col(quoted(key)).alias("_parent"))
    orphans = keys.join(parents, F.col("_key") == F.col("_parent"), "left_anti")
    violations = F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint")
    return orphans.agg(violations.alias("violations")).select(F.lit(column).alias("column"), "violations")


def integrity_checks(df: DataFrame, checks: dict[str, dict], tables: dict[str, DataFrame]) -> DataFrame:
    """Counts for ``{"foreign_key": {"column": "customer_id", "reference": "customers.id"}}``.

    The value may also be a list of such entries. ``tables`` holds the
    referenced tables by name.
    """
    unknown = set(checks) - {"foreign_key"}
    if unknown:
        raise ValueError(f"unknown integrity checks {sorted(unknown)}, only 'foreign_key' exists")
    entries = checks["foreign_key"]
    counts = []
    for entry in [entries] if isinstance(entries, dict) else entries:
        table, key = entry["reference"].split(".", 1)
        counted = orphan_count(df, entry["column"], tables[table], key)
        counts.append(counted.select("column", F.lit(entry["reference"]).alias("reference"), "violations"))
    return reduce(DataFrame.unionAll, counts)


def profile(df: DataFrame, approx: bool = False, batch: int = 8) -> DataFrame:
    """(column, type, rows, nulls, distinct), one row per column.

    ``distinct`` leaves nulls out. The exact form copies each row once per
    column it counts, so it goes through ``batch`` columns at a time and reads
    no others. ``approx=True`` uses sketches and needs one pass for all columns.
    """
    names = list(column_types(df))
    if approx:
        return _profile(df, names, F.approx_count_distinct)
    parts = [names[i : i + batch] for i in range(0, len(names), batch)]
    return reduce(DataFrame.unionAll, [_profile(df, part, F.count_distinct) for part in parts])


def _profile(df: DataFrame, names: list[str], count) -> DataFrame:
    types = column_types(df)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    rows = []
    for i, name in enumerate(names):
        c, dtype = F.col(quoted(name)), types[name]
        aggregates.append(F.count_if(missing(c, dtype)).alias(f"m{i}"))
        aggregates.append(count(nan_as_null(c, dtype)).alias(f"d{i}"))
        rows.append({
            "column": F.lit(name),
            "type": F.lit(dtype.simpleString()),
            "rows": F.col("rows"),
            "nulls": F.col(f"m{i}"),
            "distinct": F.col(f"d{i}"),
        })
    return unfold(df.agg(*aggregates), rows)


def quality_report(
    df: DataFrame,
    ranges: dict[str, dict[str, object]] | None = None,
    keys: list[list[str]] | None = None,
    foreign_keys: list[tuple[str, DataFrame, str]] | None = None,
) -> DataFrame:
    """(check, subject, violations) for ranges, unique keys and foreign keys."""
    parts = []
    if ranges:
        found = range_checks(df, ranges)
        parts.append(found.select(F.col("bound").alias("check"), F.col("column").alias("subject"), "violations"))
    for key in keys or []:
        groups = df.groupBy(*[F.col(quoted(k)) for k in key]).agg(F.count(F.lit(1)).alias("n"))
        surplus = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations"))
        parts.append(surplus.select(F.lit("unique").alias("check"), F.lit(",".join(key)).alias("subject"), "violations"))
    for column, parent, key in foreign_keys or []:
        counted = orphan_count(df, column, parent, key)
        parts.append(counted.select(F.lit("foreign_key").alias("check"), F.col("column").alias("subject"), "violations"))
    if not parts:
        raise ValueError("no checks given")
    return reduce(DataFrame.unionAll, parts)
