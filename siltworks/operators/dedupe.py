"""Duplicate rows and duplicate keys.

Every form reduces inside the map tasks before the shuffle, so a key that holds
a third of the table reaches its reducer as at most one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.names import free_names, quoted

STRATEGIES = ("keep_first", "keep_last", "keep_none")


def distinct_rows(df: DataFrame) -> DataFrame:
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if maps:
        raise TypeError(f"rows with map columns cannot be compared: {maps}")
    return df.dropDuplicates()


def dedupe(
    df: DataFrame, keys: list[str], strategy: str = "keep_first", order_by: list[str | Column] | None = None
) -> DataFrame:
    """One row per key, or only the keys that occur once.

    ``order_by`` says which row is first; it is needed for ``keep_first`` and
    ``keep_last``. Null is an ordinary key value.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, use one of {STRATEGIES}")
    if strategy == "keep_none":
        return _keep_none(df, keys)
    if not order_by:
        raise ValueError(f"{strategy} needs order_by: without it the kept row is arbitrary")
    order = [F.col(quoted(o)) if isinstance(o, str) else o for o in order_by]
    if strategy == "keep_last":
        if any("NULLS FIRST" in repr(o) or "NULLS LAST" in repr(o) for o in order):
            raise ValueError("keep_last reverses order_by itself: give columns without asc() or desc()")
        order = [o.desc_nulls_last() for o in order]
    # The filter on rank 1 is also applied before the shuffle (WindowGroupLimit).
    ranked = Window.partitionBy(*[F.col(quoted(k)) for k in keys]).orderBy(*order)
    (rank,) = free_names(df.columns, "_rank")
    return df.withColumn(rank, F.row_number().over(ranked)).filter(F.col(rank) == 1).drop(rank)


def _keep_none(df: DataFrame, keys: list[str]) -> DataFrame:
    # A count over a window would pull every row of a key into one task.
    rest = [c for c in df.columns if c not in keys]
    count, row = free_names(df.columns, "_count", "_row")
    aggregates = [F.count(F.lit(1)).alias(count)]
    if rest:
        aggregates.append(F.first(F.struct(*[F.col(quoted(c)) for c in rest])).alias(row))
    single = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*aggregates).filter(F.col(count) == 1)
    found = single.select(*[F.col(quoted(k)) for k in keys], *([F.col(f"{row}.*")] if rest else []))
    return found.select(*[F.col(quoted(c)) for c in df.columns])


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, with their number of rows."""
    counts = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") > 1)
