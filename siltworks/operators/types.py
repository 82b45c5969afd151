"""Find and set column types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.dates import parse_local, spark_pattern, wall_time
from siltworks.functions.names import quoted
from siltworks.functions.numbers import (
    lenient_cast,
    money,
    number_class,
    spark_type,
    strict,
    text_to_bigint,
    text_to_double,
)
from siltworks.operators import statistics as st

# Date formats tried on text columns, parts of column names that
# promise a date, and the format such columns are read with.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy/MM/dd",
)
DATE_NAME_PARTS = ("date", "time", "created", "updated")
NAMED_DATE_FORMAT = "yyyy-MM-dd"


@dataclass(frozen=True)
class TextTypes:
    """What the text columns hold: ``bigint`` or ``double``, or a date format."""

    numbers: dict[str, str]
    dates: dict[str, str]


def fit_text_types(
    df: DataFrame,
    columns: list[str] | None = None,
    numbers: bool = True,
    formats: tuple[str, ...] = DATE_FORMATS,
) -> TextTypes:
    """Look through all text columns at once.

    A column counts as numeric or as a date only if every value that is there
    fits, and it holds at least one. A column of numbers is never a date.
    """
    names = st.text_columns(df) if columns is None else columns
    if not names or not (numbers or formats):
        return TextTypes({}, {})
    # One row a value, so that the tests stand in the plan once: a plan with the tests of all
    # columns is too long to be compiled, and would make each value anew for every test.
    values = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.col(quoted(n)).alias("c")) for i, n in enumerate(names)])))
    c = F.col("c")
    classes = [F.col("place"), (number_class(c) if numbers else F.lit(None)).alias("number")]
    classes += [wall_time(c, fmt).isNotNull().alias(f"t{j}") for j, fmt in enumerate(formats)]
    aggregates = [F.count(F.lit(1)).alias("values"), F.count("number").alias("numbers"), F.min("number").alias("least")]
    aggregates += [F.count_if(F.col(f"t{j}")).alias(f"t{j}") for j in range(len(formats))]
    number_types, date_formats = {}, {}
    found = values.filter(c.isNotNull()).select(*classes).groupBy("place").agg(*aggregates).collect()
    for row in sorted(found, key=lambda r: r["place"]):
        name = names[row["place"]]
        fitting = [f for j, f in enumerate(formats) if row[f"t{j}"] == row["values"]]
        if numbers and row["numbers"] == row["values"]:
            number_types[name] = "bigint" if row["least"] == 2 else "double"
        elif fitting:
            date_formats[name] = fitting[0]
    return TextTypes(number_types, date_formats)


def apply_text_types(df: DataFrame, found: TextTypes) -> DataFrame:
    """Convert; text that does not fit, possible only in new data, becomes null."""
    converted = {}
    for name, kind in found.numbers.items():
        c = F.col(quoted(name))
        converted[name] = text_to_bigint(c) if kind == "bigint" else text_to_double(c)
    for name, fmt in found.dates.items():
        converted[name] = wall_time(F.col(quoted(name)), fmt)
    return df.withColumns(converted) if converted else df


def infer_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return apply_text_types(df, fit_text_types(df, columns, formats=()))


def infer_datetime(
    df: DataFrame, columns: list[str] | None = None, formats: tuple[str, ...] = DATE_FORMATS
) -> DataFrame:
    found = fit_text_types(df, columns, formats=formats)
    return apply_text_types(df, TextTypes({}, found.dates))


def name_hinted_dates(df: DataFrame, fmt: str = NAMED_DATE_FORMAT) -> DataFrame:
    """Text columns whose name promises a date become timestamps if all values parse."""
    hinted = [n for n in st.text_columns(df) if any(part in n.lower() for part in DATE_NAME_PARTS)]
    found = fit_text_types(df, hinted, numbers=False, formats=(spark_pattern(fmt),))
    return apply_text_types(df, found)


def cast_types(df: DataFrame, types: dict[str, str | T.DataType], on_error: str = "raise") -> DataFrame:
    """Cast columns to Spark or SQL types.

    ``on_error="raise"`` stops the job at a value that does not convert,
    ``"null"`` turns it into null.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error must be 'raise' or 'null', not {on_error!r}")
    sources = st.column_types(df)
    converted = {}
    for name, wanted in types.items():
        c, target = F.col(quoted(name)), spark_type(wanted)
        value = lenient_cast(c, sources[name], target)
        converted[name] = value if on_error == "null" else strict(c, value, target, name)
    return df.withColumns(converted)


def parse_dates(df: DataFrame, columns: dict[str, dict], instant: bool = False) -> DataFrame:
    """Text to time: ``{"column": {"format": "DD/MM/YYYY", "timezone": "UTC"}}``.

    Text that does not fit the format becomes null.
    """
    return df.withColumns({
        name: parse_local(
            F.col(quoted(name)), config.get("format", "YYYY-MM-DD"), config.get("timezone", "UTC"), instant
        )
        for name, config in columns.items()
    })


def currency(df: DataFrame, columns: dict[str, dict]) -> DataFrame:
    """Amounts to DECIMAL(18, places): ``{"column": {"decimal_places": 2}}``."""
    sources = st.column_types(df)
    return df.withColumns({
        name: money(F.col(quoted(name)), sources[name], config.get("decimal_places", 2), name)
        for name, config in columns.items()
    })
