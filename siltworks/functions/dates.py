"""Date text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Date tokens as users write them and the Spark pattern letters.
UPPER_TOKENS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH": "HH", "MI": "mm", "SS": "ss"}
PERCENT_TOKENS = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%b": "MMM",
    "%B": "MMMM",
    "%p": "a",
    "%I": "hh",
    "%z": "xx",
    "%%": "%",
}

_UPPER = re.compile("|".join(UPPER_TOKENS))
_PERCENT = re.compile("%[A-Za-z%]")


def spark_pattern(fmt: str) -> str:
    """Spark pattern for ``DD/MM/YYYY``, ``%d/%m/%Y`` or a Spark pattern.

    Day, month and hour accept one digit as well as two where a separator
    follows or ends the text, as strptime does.
    """
    if "%" in fmt:
        unknown = set(_PERCENT.findall(fmt)) - PERCENT_TOKENS.keys()
        if unknown:
            raise ValueError(f"date format {fmt!r} has unknown tokens {sorted(unknown)}")
        pattern = _PERCENT.sub(lambda m: PERCENT_TOKENS[m.group()], fmt)
    elif re.search("YY|DD", fmt):
        pattern = _UPPER.sub(lambda m: UPPER_TOKENS[m.group()], fmt)
    else:
        return fmt
    runs = re.findall(r"(.)\1*", pattern)
    separated = not any(a.isalpha() and b.isalpha() for a, b in zip(runs, runs[1:]))
    if separated:
        pattern = re.sub(r"(?<!d)dd(?!d)|(?<!M)MM(?!M)|(?<!H)HH(?!H)", lambda m: m.group()[0], pattern)
    return pattern


def shape(pattern: str) -> str | None:
    """Regular expression that every text of the pattern fits, or None if it has other letters."""
    quoted = re.compile(r"'([^']*)'|([A-Za-z])\2*|.", re.DOTALL)
    parts = []
    for m in quoted.finditer(pattern):
        run, letter = m.group(), m.group(2)
        if m.group(1) is not None:
            parts.append(re.escape(m.group(1)))
        elif letter is None:
            parts.append(re.escape(run))
        elif letter == "M" and len(run) > 2:
            parts.append(r"\p{L}+\.?")
        elif letter in "yMdHhmsS":
            parts.append(r"\d{1,2}" if len(run) == 1 else rf"\d{{{len(run)}}}")
        elif letter == "a":
            parts.append("[AaPp][Mm]")
        else:
            return None
    return "".join(parts)


def fixed_form(pattern: str) -> tuple[int, dict[int, str]] | None:
    """Length of every text of the pattern and the characters that stand between its digits, by place from 1; None if that varies."""
    found = shape(pattern)
    parts = re.findall(r"\\d\{(\d+)(,\d+)?\}|(\\p)|\[AaPp\](\[)|\\?(.)", found or "", re.DOTALL)
    if not found or any(upto or letters or half for _, upto, letters, half, _ in parts):
        return None
    place, marks = 0, {}
    for digits, _, _, _, mark in parts:
        place += int(digits or 1)
        if mark:
            marks[place] = mark
    return (place, marks) if all(m.isascii() for m in marks.values()) else None


def may_fit(c: Column, pattern: str) -> Column:
    """A cheap test that every text of the pattern passes: its length and the marks between its digits."""
    form = fixed_form(pattern)
    if form is None:
        return F.lit(True)
    length, marks = form
    tests = [F.octet_length(c) == length] + [F.substring(c, place, 1) == mark for place, mark in marks.items()]
    return reduce(Column.__and__, tests)


_ISO = re.compile(r"yyyy-MM?-dd?(( |'T')HH?:mm(:ss(\.S{1,6})?)?)?")


def wall_time(c: Column, pattern: str) -> Column:
    """Text of a pattern as ``timestamp_ntz``; other text is null.

    Text of another shape is turned away by its length and marks, then by a
    regular expression, as the parser refuses it by way of an exception. ISO
    text is left to the plain cast.
    """
    if _ISO.fullmatch(pattern):
        parsed = c.try_cast("timestamp_ntz")
    else:
        parsed = F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")
    expected = shape(pattern)
    return F.when(may_fit(c, pattern) & c.rlike(rf"^{expected}\z"), parsed) if expected else parsed


def parse_local(c: Column, fmt: str, zone: str = "UTC", instant: bool = False) -> Column:
    """Read text as local time of ``zone``; text that does not fit is null.

    The default result is the UTC wall time as ``timestamp_ntz``, the same under
    any session time zone. ``instant=True`` gives a ``timestamp``.
    """
    wall = wall_time(c, spark_pattern(fmt))
    if _session_in_utc():
        # Several times cheaper, and right only where wall time and instant coincide.
        shifted = wall.cast("timestamp") if zone == "UTC" else F.to_utc_timestamp(wall.cast("timestamp"), zone)
        return shifted if instant else shifted.cast("timestamp_ntz")
    if instant:
        return F.convert_timezone(F.lit(zone), F.current_timezone(), wall).cast("timestamp")
    return wall if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def _session_in_utc() -> bool:
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z")
