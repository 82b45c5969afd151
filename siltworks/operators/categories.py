"""Category values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.names import free_names, quoted
from siltworks.operators import statistics as st
from siltworks.session import materialize

# The replacement of rare values and the share below which a value is rare.
OTHER = "Other"
RARE_SHARE = 0.01
#: Bytes of values up to which a table of values is broadcast.
BROADCAST_BYTES = 32 << 20


def _looked_up(df: DataFrame, column: str, pairs: DataFrame, size: int) -> tuple[DataFrame, str, str]:
    """``df`` with the row of ``pairs`` (key, value), one a key, that has the column's text; and the names of both.

    Pairs of a proven size are broadcast. Others are joined by a shuffle, in which
    rows without a value, which match nothing, are spread by a number of their own.
    """
    key, value, spread, salt = free_names(df.columns, "_key", "_value", "_spread", "_salt")
    text = F.col(quoted(column)).cast("string")
    named = pairs.select(F.col("key").alias(key), F.col("value").alias(value))
    if size <= BROADCAST_BYTES:
        return df.join(F.broadcast(named), text == F.col(key), "left"), key, value
    apart = F.when(text.isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))).otherwise(F.lit(-1))
    salted = named.withColumn(salt, F.lit(-1).cast("bigint"))
    joined = df.withColumn(spread, apart).join(salted, (text == F.col(key)) & (F.col(spread) == F.col(salt)), "left")
    return joined.drop(spread, salt), key, value


def map_categories(df: DataFrame, column: str, mappings: dict[str, str | None]) -> DataFrame:
    """Replace values by a mapping; other values stay. The column is text afterwards, whatever the mapping holds."""
    pairs = pd.DataFrame({"key": [str(k) for k in mappings], "value": list(mappings.values())}, dtype="object")
    size = sum(len(str(x).encode()) for pair in mappings.items() for x in pair)
    table = df.sparkSession.createDataFrame(pairs, "key string, value string")
    joined, key, value = _looked_up(df, column, table, size)
    c = F.col(quoted(column)).cast("string")
    return joined.withColumn(column, F.when(F.col(key).isNotNull(), F.col(value)).otherwise(c)).drop(key, value)


def fit_frequent(
    df: DataFrame, columns: list[str] | None = None, share: float = RARE_SHARE, rows: int | None = None
) -> dict[str, list[str]]:
    """The values of each text column that are not rare; at most 1 / share of them."""
    if not 0 < share <= 1:
        raise ValueError("share must lie above 0 and up to 1")
    names = st.text_columns(df) if columns is None else columns
    return st.frequent_values(df, names, share, rows)


def keep_frequent(df: DataFrame, kept: dict[str, list[str]]) -> DataFrame:
    """Replace every value outside the kept set by ``Other``; null stays null."""
    replaced = {}
    for name, values in kept.items():
        c = F.col(quoted(name))
        replaced[name] = F.when(c.isNull() | c.isin(values), c).otherwise(F.lit(OTHER))
    return df.withColumns(replaced) if replaced else df


def rare_to_other(df: DataFrame, columns: list[str] | None = None, share: float = RARE_SHARE) -> DataFrame:
    """Values that hold less than ``share`` of the rows become ``Other``; null stays null.

    At most 1 / share values of a column are kept. They stay in a table, whose
    size decides how it meets the rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie above 0 and up to 1")
    names = st.text_columns(df) if columns is None else columns
    if not names:
        return df
    kept = materialize(st.frequent_table(df, names, share), "frequent-values")
    sizes = {r["column"]: r["size"] for r in kept.groupBy("column").agg(F.sum(F.octet_length("value") + 16).alias("size")).collect()}
    result = df
    for name in names:
        own = kept.filter(F.col("column") == name).select(F.col("value").alias("key"), "value")
        joined, key, value = _looked_up(result, name, own, sizes.get(name, 0))
        c = F.col(quoted(name))
        result = joined.withColumn(name, F.when(c.isNull() | F.col(key).isNotNull(), c).otherwise(F.lit(OTHER))).drop(key, value)
    return result


def value_share(df: DataFrame, column: str) -> DataFrame:
    """(value, count, share) of one column; the share is of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    c = F.col(quoted(column))
    counts = df.filter(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / F.lit(max(total, 1)))
