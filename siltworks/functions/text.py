"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str methods and `re` treat as white
# space and as word characters. Java's own \s and \w differ (ASCII only, or
# with combining marks under (?U)), so the classes are spelled out.
WHITESPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_whitespace(c: Column) -> Column:
    # Looks at both ends only; a pattern would be tried at every space of a long text.
    return F.trim(c, F.lit(SPACES))


def remove_special_characters(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{WORD}{WHITESPACE}]", "")


def clean_unicode(c: Column) -> Column:
    """Strip white space, lower case, keep only word characters and white space."""
    return remove_special_characters(F.lower(strip_whitespace(c)))


def clean_trim(c: Column) -> Column:
    """Lower case without leading and trailing spaces; tabs and newlines stay."""
    return F.lower(F.trim(c))
