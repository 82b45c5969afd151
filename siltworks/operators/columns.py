"""Operators on the column list and on row identity."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.names import free_names, quoted, standard_names
from siltworks.functions.numbers import missing
from siltworks.operators.statistics import Missing, column_types, missing_counts
from siltworks.session import materialize

Processor = Callable[[DataFrame], DataFrame]


def standardize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))


def run_all(df: DataFrame, processors: Iterable[Processor]) -> DataFrame:
    """Apply custom processors in order."""
    return reduce(DataFrame.transform, processors, df)


def add_metadata(df: DataFrame, run_time: datetime, source_system: str | None = None) -> DataFrame:
    """Stamp every row with the run.

    The time is one literal for the whole run: a retried task writes the same
    value and later row comparisons are not disturbed.
    """
    wall = run_time.astimezone(UTC).replace(tzinfo=None) if run_time.tzinfo else run_time
    # As text, so that the session time zone cannot shift it.
    stamp = F.lit(wall.isoformat(sep=" ")).cast("timestamp_ntz")
    if source_system is None:
        return df.withColumn("ingestion_timestamp", stamp)
    return df.withColumns({"processed_at": stamp, "source_system": F.lit(source_system)})


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is missing; NaN counts as missing."""
    return df.na.drop("all")


def missing_fraction(df: DataFrame) -> DataFrame:
    """(column, missing) with the share of missing values, from one aggregate."""
    types = column_types(df)
    names = list(types)
    shares = [F.avg(missing(F.col(quoted(n)), types[n]).cast("int")).alias(f"s{i}") for i, n in enumerate(names)]
    return unfold(df.agg(*shares), [{"column": F.lit(n), "missing": F.col(f"s{i}")} for i, n in enumerate(names)])


def unfold(one_row: DataFrame, rows: list[dict]) -> DataFrame:
    """Turn the single row of an aggregate into one row per entry of ``rows``."""
    entries = F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows])
    return one_row.select(F.inline(entries))


def sparse_columns(found: Missing, threshold: float = 0.7) -> list[str]:
    """Columns whose missing share is strictly above the threshold."""
    return [n for n in found.counts if found.share(n) > threshold]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    return df.drop(*sparse_columns(missing_counts(df), threshold))


def row_index(
    df: DataFrame,
    order_by: list[str],
    name: str = "index",
    within: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Consecutive numbers from 0 in the order of ``order_by``, per group of ``within`` if given.

    A range shuffle sorts the table in parallel and the result is written to the
    shared folder, so the positions cannot shift between the two reads. Counts per range then
    give each range its offset; no window ever spans the table or a group. Rows
    that tie are spread by a hash of the whole row, equal rows by their place in
    the input, so a long run of ties is cut as well.
    """
    if not order_by:
        raise ValueError("row_index needs order_by: without it the numbering is arbitrary")
    group = [F.col(quoted(c)) for c in within or []]
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie, place, place_id, first = free_names([*df.columns, name], "_tie", "_place", "_id", "_first")
    ties = {tie: F.xxhash64(*[F.col(quoted(c)) for c in df.columns]), place: F.monotonically_increasing_id()}
    keys = [*group, *[F.col(quoted(c)) for c in order_by], F.col(tie), F.col(place)]
    ordered = (
        df.withColumns(ties)
        .repartitionByRange(count, *keys)
        .sortWithinPartitions(*keys)
        .drop(*ties)
        .withColumn(place_id, F.monotonically_increasing_id())
    )
    fixed = materialize(ordered, "ordered")
    # monotonically_increasing_id holds the partition above bit 33 and the position below.
    block = F.shiftright(place_id, 33).cast("int")
    counted = fixed.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("rows"))
    sizes = {r["block"]: r["rows"] for r in counted.collect()}
    offsets, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(i, 0)
    start = F.lit(offsets or [0])[block].cast("bigint")
    position = F.col(place_id).bitwiseAND(F.lit((1 << 33) - 1))
    columns = [F.col(quoted(c)) for c in df.columns]
    numbered = fixed.select((start + position).alias(name), *columns)
    if not group:
        return numbered
    # The first number of each group turns the numbers of the table into numbers of the group.
    keys = free_names([*df.columns, name, first], *[f"_g{i}" for i in range(len(group))])
    starts = numbered.groupBy(*[g.alias(k) for g, k in zip(group, keys)]).agg(F.min(quoted(name)).alias(first))
    same = [g.eqNullSafe(F.col(k)) for g, k in zip(group, keys)]
    return numbered.join(starts, same).select((F.col(quoted(name)) - F.col(first)).alias(name), *columns)
