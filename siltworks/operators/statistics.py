"""Column statistics that stay exact on any size of table.

Nothing here gathers a column in one task. Quantiles are found by narrowing a
bracket around the wanted rank, modes and frequent values by counts that are
combined before each shuffle. What reaches the driver is bounded by the number
of columns, or by 1 / share for frequent values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.names import quoted
from siltworks.functions.numbers import is_numeric, missing, nan_as_null

# Values that one aggregate may hold for ranking, shared by the columns it ranks.
RANK_BUDGET = 1_000_000
# Each narrowing pass keeps about 4 / ACCURACY of the rows it looked at.
ACCURACY = 10_000


def column_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


@dataclass(frozen=True)
class Missing:
    """Row count of a table and the missing values of each column."""

    rows: int
    counts: dict[str, int]

    def share(self, name: str) -> float:
        return self.counts[name] / self.rows if self.rows else 0.0


@dataclass(frozen=True)
class Span:
    """How many values a numeric column holds, and its ends; NaN counts as missing."""

    values: int
    low: object
    high: object


def overview(df: DataFrame, columns: list[str] | None = None) -> tuple[Missing, dict[str, Span]]:
    """Missing values of the given columns and spans of the numeric ones, in one pass."""
    types = column_types(df)
    names = list(types) if columns is None else columns
    numeric = [n for n in names if is_numeric(types[n])]
    aggregates = [F.count(nan_as_null(F.col(quoted(n)), types[n])).alias(f"n{i}") for i, n in enumerate(names)]
    for i, n in enumerate(numeric):
        c = nan_as_null(F.col(quoted(n)), types[n])
        aggregates += [F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggregates).first()
    values = {n: row[f"n{i}"] for i, n in enumerate(names)}
    found = Missing(row["rows"], {n: row["rows"] - v for n, v in values.items()})
    return found, {n: Span(values[n], row[f"l{i}"], row[f"h{i}"]) for i, n in enumerate(numeric)}


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> Missing:
    """One pass over the given columns."""
    types = column_types(df)
    names = list(types) if columns is None else columns
    aggregates = [F.count_if(missing(F.col(quoted(n)), types[n])).alias(f"m{i}") for i, n in enumerate(names)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggregates).first()
    return Missing(row["rows"], {n: row[f"m{i}"] for i, n in enumerate(names)})


# --------------------------------------------------------------------------
# Quantiles


@dataclass(frozen=True)
class _Bracket:
    """The wanted value has index ``rank`` in sorted order and lies in [low, high].

    ``position`` is the possibly fractional index of the quantile; the two ranks
    around it share every aggregate as long as they share a bracket.
    """

    column: str
    rank: int
    position: float
    low: object
    high: object
    below: int  # values < low
    inside: int  # values in [low, high]
    between: int  # values strictly between low and high


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    limit: int | None = None,
    known: dict[str, Span] | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation between neighbours.

    Null and NaN are left out; a column without values gives ``None``. A first
    pass counts each column that is not in ``known``. Columns of up to ``limit``
    values, by default their part of the budget, are then ranked by one aggregate
    whose state cannot exceed that. For longer ones, sketches propose tighter brackets and exact counts
    confirm them until what lies strictly inside is that small too. A value
    repeated many times is one entry of the state, so hot values cost nothing.
    """
    if not wanted:
        return {}
    limit = limit or max(RANK_BUDGET // len(wanted), 1)
    types = column_types(df)
    found = dict(known or {})
    unknown = [n for n in wanted if n not in found]
    if unknown:
        found |= overview(df, unknown)[1]
    work = df.select(
        *[nan_as_null(F.col(quoted(n)), types[n]).alias(f"c{i}") for i, n in enumerate(wanted)]
    )
    cols = {n: f"c{i}" for i, n in enumerate(wanted)}
    brackets: dict[tuple[str, int], _Bracket] = {}
    positions: dict[str, list[float]] = {}
    for name, quantiles in wanted.items():
        c, span = cols[name], found[name]
        n = span.values
        positions[name] = [q * (n - 1) for q in quantiles] if n else []
        for position in positions[name]:
            for rank in {math.floor(position), math.ceil(position)}:
                brackets[c, rank] = _Bracket(c, rank, position, span.low, span.high, 0, n, n)
    _narrow(work, brackets, limit)
    values = _ranked(work, brackets)
    result: dict[str, list[float | None]] = {}
    for name, quantiles in wanted.items():
        result[name] = [
            _interpolate(values[cols[name], math.floor(p)], values[cols[name], math.ceil(p)], p - math.floor(p))
            for p in positions[name]
        ] or [None] * len(quantiles)
    return result


def _interpolate(low: float, high: float, fraction: float) -> float:
    return low if fraction == 0 or low == high else low + (high - low) * fraction


def _narrow(work: DataFrame, brackets: dict[tuple[str, int], _Bracket], limit: int) -> None:
    halve = False
    while True:
        wide = {k: b for k, b in brackets.items() if b.between > limit}
        if not wide:
            return
        # Ranks with the same bracket and position get the same proposal.
        groups = {k: (b.column, b.low, b.high, b.below, b.inside, b.position) for k, b in wide.items()}
        propose = _halves if halve else _propose
        proposals = propose(work, set(groups.values()))
        counted = _count(work, {(g[0], *ends) for g, ends in proposals.items()})
        shrunk = False
        for key, group in groups.items():
            low, high = proposals[group]
            b, (below, inside, between, at_low, at_high) = wide[key], counted[group[0], low, high]
            if below <= b.rank < below + inside:
                new = replace(b, low=low, high=high, below=below, inside=inside, between=between)
            elif b.rank < below:
                # The sketch was off: the value lies in [b.low, low].
                new = replace(b, high=low, inside=below - b.below + at_low, between=below - b.below)
            else:
                start = below + inside - at_high
                rest = b.below + b.inside - start
                new = replace(b, low=high, below=start, inside=rest, between=rest - at_high)
            shrunk |= new.between < b.between
            brackets[key] = new
        # Sketches normally shrink every bracket a thousandfold; halving always ends.
        halve = not shrunk


def _inside(column: str, low, high) -> Column:
    c = F.col(column)
    return F.when((c >= F.lit(low)) & (c <= F.lit(high)), c)


def _propose(work: DataFrame, groups: set[tuple]) -> dict[tuple, tuple]:
    """Bracket ends a little below and above each position; one sketch per bracket."""
    sketches: dict[tuple, list[tuple]] = {}
    for group in groups:
        sketches.setdefault(group[:3], []).append(group)
    margin = 2.0 / ACCURACY
    aggregates = []
    for i, (bracket, members) in enumerate(sketches.items()):
        ends = []
        for *_, below, inside, position in members:
            last = max(inside - 1, 1)
            low, high = (math.floor(position) - below) / last - margin, (math.ceil(position) - below) / last + margin
            ends += [F.lit(min(max(0.0, p), 1.0)) for p in (low, high)]
        aggregates.append(F.percentile_approx(_inside(*bracket), F.array(*ends), ACCURACY).alias(f"b{i}"))
    row = work.agg(*aggregates).first()
    return {
        group: tuple(row[f"b{i}"][2 * j : 2 * j + 2])
        for i, members in enumerate(sketches.values())
        for j, group in enumerate(members)
    }


def _halves(work: DataFrame, groups: set[tuple]) -> dict[tuple, tuple]:
    """The lower half of each bracket by value."""
    return {g: (g[1], g[1] + (g[2] - g[1]) // 2 if isinstance(g[1], int) else g[1] / 2 + g[2] / 2) for g in groups}


def _count(work: DataFrame, brackets: set[tuple]) -> dict[tuple, tuple[int, ...]]:
    """Values below, inside, strictly inside, at the low end and at the high end."""
    names = list(brackets)
    aggregates = []
    for i, (column, *ends) in enumerate(names):
        c, (low, high) = F.col(column), map(F.lit, ends)
        aggregates += [
            F.count_if(c < low).alias(f"b{i}"),
            F.count_if((c >= low) & (c <= high)).alias(f"i{i}"),
            F.count_if((c > low) & (c < high)).alias(f"s{i}"),
            F.count_if(c == low).alias(f"l{i}"),
            F.count_if(c == high).alias(f"h{i}"),
        ]
    row = work.agg(*aggregates).first()
    return {name: tuple(row[f"{p}{i}"] for p in "bislh") for i, name in enumerate(names)}


def _ranked(work: DataFrame, brackets: dict[tuple[str, int], _Bracket]) -> dict[tuple[str, int], float]:
    """Order statistics inside brackets that are known to be small.

    Ranks that share a bracket share one aggregate state.
    """
    groups: dict[tuple, list[_Bracket]] = {}
    for b in brackets.values():
        groups.setdefault((b.column, b.low, b.high, b.below, b.inside), []).append(b)
    if not groups:
        return {}
    aggregates = []
    for i, members in enumerate(groups.values()):
        b = members[0]
        shares = ", ".join(repr((m.rank - m.below + 0.5) / m.inside) + "D" for m in members)
        aggregates.append(
            F.expr(f"percentile_disc(array({shares})) within group (order by v{i})").alias(f"r{i}")
        )
    picked = work.select(*[_inside(*g[:3]).alias(f"v{i}") for i, g in enumerate(groups)])
    # Most rows lie in no bracket; only the others reach the ranking.
    useful = reduce(Column.__or__, [F.col(f"v{i}").isNotNull() for i in range(len(groups))])
    row = picked.filter(useful).agg(*aggregates).first()
    return {
        (m.column, m.rank): float(value)
        for i, members in enumerate(groups.values())
        for m, value in zip(members, row[f"r{i}"])
    }


def approximate_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """One pass; each answer is a value whose rank is within rows / accuracy."""
    if not wanted:
        return {}
    types = column_types(df)
    aggregates = [
        F.percentile_approx(
            nan_as_null(F.col(quoted(n)), types[n]).cast("double"), F.array(*map(F.lit, qs)), accuracy
        ).alias(f"q{i}")
        for i, (n, qs) in enumerate(wanted.items())
    ]
    row = df.agg(*aggregates).first()
    return {n: list(row[f"q{i}"]) if row[f"q{i}"] else [None] * len(qs) for i, (n, qs) in enumerate(wanted.items())}


# --------------------------------------------------------------------------
# Counts of values


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) for all given text columns, nulls left out.

    One shuffle for all columns. The counts are combined in each map task, so
    a value that fills a third of the table arrives as one row per task.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(quoted(n)).alias("value")) for n in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.column", "p.value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _hash_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, hash, count): as :func:`value_counts`, but 8 bytes travel for a value of any length."""
    hashes = df.select(F.explode(F.array(*[
        F.struct(
            F.lit(n).alias("column"),
            F.when(F.col(quoted(n)).isNotNull(), F.xxhash64(F.col(quoted(n)))).alias("hash"),
        )
        for n in columns
    ])).alias("p")).select("p.*")
    return hashes.filter(F.col("hash").isNotNull()).groupBy("column", "hash").agg(F.count(F.lit(1)).alias("count"))


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value of each text column; on a tie the smallest.

    The first pass counts hashes. The values of the one or two most frequent
    hashes are then counted by value, which also shows a hash that two values
    share. Only a column with more values on a tie is counted by value in full,
    and one without any repeated value just gives its smallest.
    """
    if not columns:
        return {}
    tied = _hash_counts(df, columns).groupBy("column", "count").agg(
        F.count(F.lit(1)).alias("ties"), F.min("hash").alias("low"), F.max("hash").alias("high")
    )
    best = tied.groupBy("column").agg(F.max(F.struct("count", "ties", "low", "high")).alias("best"))
    top = {r["column"]: r for r in best.select("column", "best.*").collect()}
    found: dict[str, str | None] = dict.fromkeys(columns)
    unique = [n for n, r in top.items() if r["count"] == 1]
    if unique:
        row = df.agg(*[F.min(F.col(quoted(n))).alias(f"m{i}") for i, n in enumerate(unique)]).first()
        found |= {n: row[f"m{i}"] for i, n in enumerate(unique)}

    def counted(candidates: DataFrame, names: list[str]) -> dict[str, tuple[int, str]]:
        lead = F.min(F.struct((-F.col("count")).alias("rank"), F.col("value"))).alias("best")
        rows = value_counts(candidates, names).groupBy("column").agg(lead).select("column", "best.*").collect()
        return {r["column"]: (-r["rank"], r["value"]) for r in rows}

    few = [n for n, r in top.items() if r["count"] > 1 and r["ties"] <= 2]
    many = [n for n, r in top.items() if r["count"] > 1 and r["ties"] > 2]
    if few:
        candidates = df.select(*[
            F.when(F.xxhash64(F.col(quoted(n))).isin(top[n]["low"], top[n]["high"]), F.col(quoted(n))).alias(n) for n in few
        ])
        for n, (count, value) in counted(candidates, few).items():
            if count == top[n]["count"]:
                found[n] = value
            else:  # two values share the hash
                many.append(n)
    if many:
        found |= {n: value for n, (_, value) in counted(df, many).items()}
    return found


def frequent_table(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """(column, value) of the values that hold at least ``share`` of all rows, as a table of at most 1 / share rows a column."""
    total = df.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    often = F.col("count") / F.lit(max(total, 1)) >= share
    return value_counts(df, columns).filter(often).select("column", "value")


def frequent_values(
    df: DataFrame, columns: list[str], share: float, rows: int | None = None
) -> dict[str, list[str]]:
    """Values that hold at least ``share`` of all rows, nulls counted in the total.

    At most 1 / share values per column can qualify, which bounds the answer.
    The first pass shuffles 8-byte hashes in place of the values; only the rows
    whose hash is frequent are then counted by value. ``rows`` is the number of
    rows where it is known.
    """
    if not columns:
        return {}
    total = df.agg(F.count(F.lit(1)).alias("rows")).first()["rows"] if rows is None else rows

    def often(counts: DataFrame) -> DataFrame:
        return counts.filter(F.col("count") / F.lit(max(total, 1)) >= share)

    per_hash = _hash_counts(df, columns)
    found: dict[str, list[int]] = {}
    for r in often(per_hash).collect():
        found.setdefault(r["column"], []).append(r["hash"])
    result: dict[str, list[str]] = {n: [] for n in columns}
    if found:
        candidates = df.select(*[
            F.when(F.xxhash64(F.col(quoted(n))).isin(h), F.col(quoted(n))).alias(n) for n, h in found.items()
        ])
        for r in often(value_counts(candidates, list(found))).collect():
            result[r["column"]].append(r["value"])
    return {n: sorted(v) for n, v in result.items()}
