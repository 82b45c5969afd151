"""Text normalisation over columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.names import quoted
from siltworks.functions.text import clean_trim, clean_unicode
from siltworks.operators.statistics import text_columns


def clean_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip, lower case, drop special characters. Null stays null."""
    names = text_columns(df) if columns is None else columns
    return df.withColumns({n: clean_unicode(F.col(quoted(n))) for n in names}) if names else df


def trim_lower(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({n: clean_trim(F.col(quoted(n))) for n in columns})
