"""Fill missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.names import quoted
from siltworks.functions.numbers import INTEGRAL, nan_as_null
from siltworks.operators import statistics as st

UNKNOWN = "Unknown"


def fit_medians(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> dict[str, float]:
    """Median of every numeric column that has something to fill.

    A column that is missing throughout has no median and is left out.
    """
    names = st.numeric_columns(df) if columns is None else columns
    found, spans = st.overview(df, names)
    return medians(df, [n for n in names if 0 < found.counts[n] < found.rows], approx, spans)


def medians(
    df: DataFrame, columns: list[str], approx: bool = False, known: dict[str, st.Span] | None = None
) -> dict[str, float]:
    wanted = {n: [0.5] for n in columns}
    answer = st.approximate_quantiles(df, wanted) if approx else st.exact_quantiles(df, wanted, known=known)
    return {n: v[0] for n, v in answer.items() if v[0] is not None}


def fit_modes(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Most frequent value of every text column that has something to fill."""
    names = st.text_columns(df) if columns is None else columns
    found = st.missing_counts(df, names)
    return modes(df, [n for n in names if found.counts[n]])


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    return {n: UNKNOWN if v is None else v for n, v in st.modes(df, columns).items()}


def fill_values(df: DataFrame, values: dict[str, float | str]) -> DataFrame:
    """Replace missing values by fitted ones.

    A whole-number column keeps its type unless its median has a fraction; then
    it becomes double.
    """
    types = st.column_types(df)
    return df.withColumns({n: _filled(n, types[n], v) for n, v in values.items()}) if values else df


def _filled(name: str, dtype: T.DataType, value) -> Column:
    c = F.col(quoted(name))
    if isinstance(dtype, INTEGRAL + (T.DecimalType,)) and not float(value).is_integer():
        return F.coalesce(c.cast("double"), F.lit(value))
    filler = F.lit(int(value)) if isinstance(dtype, INTEGRAL) else F.lit(value)
    return F.coalesce(nan_as_null(c, dtype), filler.cast(dtype))


def fill_median(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    return fill_values(df, fit_medians(df, columns, approx))


def fill_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return fill_values(df, fit_modes(df, columns))


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Replace nulls by a given value or column expression."""
    types = st.column_types(df)
    filled = {}
    for name, default in defaults.items():
        other = default if isinstance(default, Column) else F.lit(default).cast(types[name])
        filled[name] = F.coalesce(F.col(quoted(name)), other)
    return df.withColumns(filled)


def fill_zero_unknown(df: DataFrame) -> DataFrame:
    """Missing numbers become 0, null text becomes ``Unknown``."""
    return df.na.fill(0).na.fill(UNKNOWN)
