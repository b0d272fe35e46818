"""Text functions with Unicode white space as Python counts it, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points of white space, as a class that Java and RE2 read alike.
SPACES = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """For ``withColumn``: a value that the optimizer neither copies into later filters nor computes again."""
    return F.explode_outer(F.array(value))


def words(text: Column) -> Column:
    """The words of a text; an empty array for none."""
    return F.array_remove(F.split(text, SPACES + "+"), "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def squeeze(text: Column) -> Column:
    """Words with one space between them."""
    return F.array_join(words(text), " ")


def has_any(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | text.contains(n)
    return found


def begins_with_any(text: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | text.startswith(n)
    return found


def occurrences(text: Column, needle: str) -> Column:
    """How often ``needle`` stands in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def normalized(text: Column) -> Column:
    return squeeze(F.lower(text))
