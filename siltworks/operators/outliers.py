"""Cap values far from the middle half of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.names import quoted
from siltworks.functions.numbers import nan_as_null
from siltworks.operators import statistics as st

# Fixed value: how many interquartile ranges beyond the quartiles are still kept.
FENCE = 1.5


def fit_fences(
    df: DataFrame,
    columns: list[str] | None = None,
    exclude: tuple[str, ...] = (),
    approx: bool = False,
    known: dict[str, st.Span] | None = None,
) -> dict[str, tuple[float, float]]:
    """(lowest, highest) value to keep for each numeric column."""
    names = [n for n in (st.numeric_columns(df) if columns is None else columns) if n not in exclude]
    wanted = {n: [0.25, 0.75] for n in names}
    quartiles = st.approximate_quantiles(df, wanted) if approx else st.exact_quantiles(df, wanted, known=known)
    fences = {}
    for name, (q1, q3) in quartiles.items():
        if q1 is not None:
            reach = FENCE * (q3 - q1)
            fences[name] = (q1 - reach, q3 + reach)
    return fences


def cap(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip to the fences. Null stays null; capped columns are double."""
    types = st.column_types(df)
    capped = {}
    for name, (low, high) in fences.items():
        value = nan_as_null(F.col(quoted(name)), types[name]).cast("double")
        clipped = F.greatest(F.least(value, F.lit(high)), F.lit(low))
        capped[name] = F.when(value.isNotNull(), clipped)
    return df.withColumns(capped) if capped else df


def cap_outliers(
    df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = (), approx: bool = False
) -> DataFrame:
    return cap(df, fit_fences(df, columns, exclude, approx))
