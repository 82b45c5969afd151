"""Lenient typing rules of the data contracts, as column expressions.

Each rule answers null for a value that the type refuses; the caller tells a
refused value from a null one by looking at the input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.numbers import FRACTIONAL, INTEGRAL, PLAIN_NUMBER, PLAIN_WHOLE
from siltworks.functions.text import strip_whitespace

# Spellings the contract types accept.
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "f", "false", "n", "no", "off"]
WHOLE_NUMBER = r"^[+-]?\d+(_\d+)*(\.0+)?\z"
REAL_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\z"
STRAY_UNDERSCORE = "^_|__|_$"
EPOCH_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)\z"
ISO_DATETIME = r"(?i)^\d{4}-\d\d-\d\d([t _]\d\d:\d\d(:\d\d([.,]\d+)?)?(z|[+-]\d\d:?\d\d)?)?\z"
# Epoch numbers above this are milliseconds, below it seconds.
EPOCH_MILLIS_FROM = 2e10
# Years 1 to 9999.
EPOCH_SECONDS_MIN = -62135596800
EPOCH_SECONDS_MAX = 253402300799

KINDS = {
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "str": T.StringType(),
    "datetime": T.TimestampType(),
}


def _null(kind: str) -> Column:
    return F.lit(None).cast(KINDS[kind])


def _guarded(text: Column, pattern: str, converted: Column) -> Column:
    return F.when(text.rlike(pattern), converted)


def _to_int(c: Column, source: T.DataType) -> Column:
    if isinstance(source, INTEGRAL + (T.BooleanType,)):
        return c.cast("bigint")
    if isinstance(source, (T.DecimalType,) + FRACTIONAL):
        return F.when(c == F.floor(c), c.try_cast("bigint"))
    if isinstance(source, T.StringType):
        text = strip_whitespace(c)
        digits = F.regexp_replace(text, r"_|\.0+$", "")
        plain = F.when(c.rlike(PLAIN_WHOLE), c.try_cast("bigint"))
        return plain.when(text.rlike(WHOLE_NUMBER), digits.try_cast("bigint"))
    return _null("int")


def _to_float(c: Column, source: T.DataType) -> Column:
    if isinstance(source, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(source, T.StringType):
        text = strip_whitespace(c)
        digits = F.regexp_replace(text, "_", "")
        number = F.regexp_replace(digits, "(?i)^[+-]nan$", "nan").try_cast("double")
        plain = F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double"))
        return plain.when(digits.rlike(REAL_NUMBER) & ~text.rlike(STRAY_UNDERSCORE), number)
    return _null("float")


def _to_bool(c: Column, source: T.DataType) -> Column:
    if isinstance(source, T.BooleanType):
        return c
    if isinstance(source, T.NumericType):
        return F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False))
    if isinstance(source, T.StringType):
        word = F.lower(c)
        return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))
    return _null("bool")


def _to_str(c: Column, source: T.DataType) -> Column:
    return c if isinstance(source, T.StringType) else _null("str")


def _epoch(number: Column) -> Column:
    seconds = F.when(F.abs(number) > EPOCH_MILLIS_FROM, number / 1000).otherwise(number)
    in_range = seconds.between(EPOCH_SECONDS_MIN, EPOCH_SECONDS_MAX)
    return F.when(in_range, F.timestamp_micros(F.rint(seconds * 1e6).try_cast("bigint")))


def _iso(text: Column) -> Column:
    upper = F.regexp_replace(F.upper(text), "[_ ]", "T")
    point = F.regexp_replace(upper, ",", ".")
    micros = F.regexp_replace(point, r"(\.\d{6})\d+", "$1")
    zone = F.regexp_replace(micros, r"([+-]\d\d)(\d\d)$", "$1:$2")
    # A bare date ends in -MM-DD, which the zone pattern cannot match.
    return zone.try_cast("timestamp")


def _to_datetime(c: Column, source: T.DataType) -> Column:
    if isinstance(source, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(source, T.NumericType):
        return _epoch(c.cast("double"))
    if isinstance(source, T.StringType):
        number = _guarded(c, EPOCH_NUMBER, c.try_cast("double"))
        return F.coalesce(_guarded(c, ISO_DATETIME, _iso(c)), _epoch(number))
    return _null("datetime")


_RULES = {"int": _to_int, "float": _to_float, "bool": _to_bool, "str": _to_str, "datetime": _to_datetime}


def coerce(c: Column, source: T.DataType, kind: str) -> Column:
    return _RULES[kind](c, source)
