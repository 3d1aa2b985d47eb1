"""String building blocks shared by every tag and caption expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Unicode-aware string stripping treats as blank,
# as a string and as a pattern valid for java.util.regex and for RE2.
BLANKS = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK = (
    r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside higher-order functions Spark does not share common
    subexpressions, so an expensive value used twice would be computed twice.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove leading and trailing blanks of any kind, not only spaces."""
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """Turn every run of blanks into one space."""
    # Mapping all blanks to spaces first is cheaper than one wide pattern.
    return F.regexp_replace(F.translate(text, BLANKS, " " * len(BLANKS)), " {2,}", " ")


def words(text: Column) -> Column:
    """The text cut at runs of blanks."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def non_blank(text: Column) -> Column:
    """The stripped text, or NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def fold(text: Column) -> Column:
    """Comparison key of a tag: stripped and lower-cased."""
    return F.lower(strip(text))
