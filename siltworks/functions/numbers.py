"""Numeric casts and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.text import WHITESPACE, strip_whitespace

# SQL type names of the source system and what they are in Spark.
SQL_TYPE_NAMES = {
    "BIGINT": "bigint",
    "BLOB": "binary",
    "BOOL": "boolean",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "DATETIME": "timestamp_ntz",
    "DOUBLE": "double",
    "FLOAT": "float",
    "FLOAT4": "float",
    "FLOAT8": "double",
    "HUGEINT": "decimal(38,0)",
    "INT": "int",
    "INT1": "tinyint",
    "INT2": "smallint",
    "INT4": "int",
    "INT8": "bigint",
    "INTEGER": "int",
    "LONG": "bigint",
    "REAL": "float",
    "SHORT": "smallint",
    "SMALLINT": "smallint",
    "STRING": "string",
    "TEXT": "string",
    "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMP WITH TIME ZONE": "timestamp",
    "TIMESTAMPTZ": "timestamp",
    "TINYINT": "tinyint",
    "VARCHAR": "string",
}

# How numbers are written in text columns.
NUMBER_SHAPE = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?([nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)"
WHOLE_SHAPE = r"[+-]?\d+"
# The common spellings among them, told by a short pattern and cast as they are.
PLAIN_NUMBER = r"^[+-]?\d+(\.\d*)?([eE][+-]?\d+)?\z"
PLAIN_WHOLE = r"^[+-]?\d{1,18}\z"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)


def spark_type(name: str | T.DataType) -> T.DataType:
    """A Spark type from a Spark type, a Spark type name or a SQL type name."""
    if isinstance(name, T.DataType):
        return name
    text = " ".join(name.split())
    return T.DataType.fromDDL(SQL_TYPE_NAMES.get(text.upper(), text))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def missing(c: Column, dtype: T.DataType) -> Column:
    """True where the value is null or, for floating point, not a number."""
    return (c.isNull() | F.isnan(c)) if isinstance(dtype, FRACTIONAL) else c.isNull()


def spaced(shape: str) -> str:
    """Pattern for a whole text of the given shape with white space around it."""
    return rf"^[{WHITESPACE}]*({shape})[{WHITESPACE}]*\z"


def text_to_double(c: Column) -> Column:
    """Number in a text; null for other text.

    The pattern comes first: Spark's own parser also takes spellings such as
    ``1d``, and refuses a text by way of an exception, which is slow.
    """
    stripped = F.regexp_replace(strip_whitespace(c), "(?i)^[+-](nan)$", "$1")
    plain = F.when(F.trim(c).rlike(PLAIN_NUMBER), c.try_cast("double"))
    return plain.when(c.rlike(spaced(NUMBER_SHAPE)), stripped.try_cast("double"))


def text_to_bigint(c: Column) -> Column:
    plain = F.when(F.trim(c).rlike(PLAIN_WHOLE), c.try_cast("bigint"))
    return plain.when(c.rlike(spaced(WHOLE_SHAPE)), strip_whitespace(c).try_cast("bigint"))


def may_be_number(c: Column) -> Column:
    """A cheap test that every number passes: how its text begins. White space other than spaces and letters beyond ASCII are let through."""
    first = F.ascii(F.ltrim(c))
    begins = first.between(48, 57) | first.isin(*map(ord, "+-.nNiI"))
    return begins | first.between(1, 31) | (first > 126)


def number_class(c: Column) -> Column:
    """2 for a whole number that fits 64 bits, 1 for another number, null for other text.

    Patterns go from the commonest to the rarest, so most values meet one of
    them, and text that does not begin like a number meets none. Whole numbers of
    up to 18 digits always fit; only longer and oddly spaced ones are parsed to see.
    """
    plain = F.trim(c)
    whole = F.when(text_to_bigint(c).isNotNull(), 2).otherwise(1)
    found = (
        F.when(plain.rlike(PLAIN_WHOLE), 2)
        .when(plain.rlike(PLAIN_NUMBER), F.when(plain.rlike(r"^[+-]?\d+\z"), whole).otherwise(1))
        .when(c.rlike(spaced(NUMBER_SHAPE)), F.when(c.rlike(spaced(WHOLE_SHAPE)), whole).otherwise(1))
    )
    return F.when(may_be_number(c), found)


def nan_as_null(c: Column, dtype: T.DataType) -> Column:
    return F.nanvl(c, F.lit(None).cast(dtype)) if isinstance(dtype, FRACTIONAL) else c


def float_to_decimal(c: Column, target: T.DecimalType) -> Column:
    """Floating point to decimal: scaled in binary, then rounded half away from zero.

    That is how the source system stores such values; going through the decimal
    text instead differs for values half way between two units.
    """
    scaled = c.cast("double") * float(10**target.scale)
    even = F.rint(scaled)
    units = F.when(F.abs(scaled - even) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(even)
    unit = F.lit(f"{10.0**-target.scale:.{target.scale}f}").cast(T.DecimalType(target.scale + 1, target.scale))
    if target.precision <= 18:
        return (units.try_cast("decimal(18,0)") * unit).try_cast(target)
    # The product must fit 38 digits; beyond that, and for scales this leaves no room for, a double has no fraction left to round.
    whole = min(target.precision, 36 - target.scale)
    scaled_value = (units.try_cast(T.DecimalType(whole, 0)) * unit).try_cast(target) if whole > 0 else F.lit(None).cast(target)
    return F.coalesce(scaled_value, c.try_cast(target))


def lenient_cast(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast that gives null for a value the target cannot hold.

    To whole numbers it rounds instead of cutting off: half to even for
    floating point, half away from zero for decimals and text.
    """
    if isinstance(target, INTEGRAL):
        if isinstance(source, FRACTIONAL):
            return F.rint(c).try_cast(target)
        if isinstance(source, T.DecimalType):
            return F.round(c, 0).try_cast(target)
        if isinstance(source, T.StringType):
            # Digits beyond the decimal type are cut off, not rounded, so that rounding happens once.
            digits = F.regexp_replace(F.trim(c), r"(\.\d{18})\d+$", "$1")
            return F.round(digits.try_cast("decimal(38,18)"), 0).try_cast(target)
    if isinstance(target, T.DecimalType) and isinstance(source, FRACTIONAL):
        return float_to_decimal(c, target)
    return c.try_cast(target)


def strict(c: Column, converted: Column, target: T.DataType, label: str) -> Column:
    """``converted``, but a value lost in the conversion stops the job."""
    problem = F.raise_error(F.concat(F.lit(f"{label}: cannot convert "), c.cast("string")))
    return F.when(c.isNull() | converted.isNotNull(), converted).otherwise(problem.cast(target))


def money(c: Column, source: T.DataType, places: int, label: str = "amount") -> Column:
    """DECIMAL(18, places), rounded half away from zero; too large a value is an error."""
    target = T.DecimalType(18, places)
    return strict(c, lenient_cast(c, source, target), target, label)
