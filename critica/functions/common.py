"""Small Column helpers shared by all modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, as a regex class usable by both
# Java regex and RE2 (the oracle). Plain \s differs between engines (Java ASCII, RE2 ASCII).
WS_CLASS = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NON_WS_CLASS = "[^" + WS_CLASS[1:]
# The same characters, one by one.
WHITESPACE = "".join(map(chr, (*range(9, 14), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                               0x2028, 0x2029, 0x202f, 0x205f, 0x3000)))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_round(x, digits: int) -> Column:
    """Half-up rounding written as floor(x*10^d + 0.5)/10^d so Spark and DuckDB agree bit for bit.

    Spark's ``round`` is half-up on the decimal text and DuckDB's differs on values such as 1.005
    (see SURVEY Q3); one arithmetic expression keeps both engines identical."""
    scale = float(10 ** digits)
    return F.floor(col(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable is not inlined where it is used."""
    return F.transform(F.array(value), body)[0]


def ustrip(x) -> Column:
    """Strip leading/trailing Unicode whitespace like Python's ``str.strip()``.

    Looks at the ends alone: a pattern for the end is tried at each blank inside, and reads a run of blanks once from each."""
    return F.btrim(col(x), F.lit(WHITESPACE))


def is_blank(x) -> Column:
    """True when the string has no non-whitespace character (Python ``not s.strip()``)."""
    return ~col(x).rlike(NON_WS_CLASS)
