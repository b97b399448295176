"""Coercion, rounding and small Column helpers, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once for `body`.

    A Column used twice inside a lambda is evaluated for each element; binding it
    as a lambda variable keeps array code linear in the length of the array.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def round_even(value: Column, digits: int) -> Column:
    """Round half to even by scaling, the rule of numeric array libraries."""
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def clip01(value: Column) -> Column:
    """Value limited to [0, 1]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)))


def normalize_id(value: Column, strip: bool = True) -> Column:
    """Id as text with every literal `.0` removed; a null id stays null."""
    text = F.replace(value.cast("string"), F.lit(".0"), F.lit(""))
    return F.trim(text) if strip else text


def to_number(value: Column) -> Column:
    """Double, or null where the value is no number; NaN counts as no number."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def text_number(value: Column) -> Column:
    """Double from text; the type suffixes that Java accepts (`7d`, `7f`) are no numbers."""
    return F.when(~value.rlike(r"[0-9.][dDfF]\s*$"), to_number(value))


def to_timestamp_utc(value: Column) -> Column:
    """Timestamp, or null where the text is no timestamp (session zone UTC)."""
    return F.try_to_timestamp(value.cast("string"))


def truth(value: Column) -> Column:
    """True where the text reads true, 1 or yes."""
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1", "yes"), F.lit(False))


def split_list(value: Column, delimiter: str = "|") -> Column:
    """Delimited text as an array: trimmed, empty items dropped, null -> empty array."""
    pattern = "".join("\\" + c if c in "|\\.^$*+?()[]{}" else c for c in delimiter)
    items = F.transform(F.split(F.coalesce(value.cast("string"), F.lit("")), pattern),
                        lambda item: F.trim(item))
    return F.filter(items, lambda item: item != F.lit(""))


def join_list(value: Column, delimiter: str = " | ") -> Column:
    """Array as delimited text; null array -> empty text."""
    return F.coalesce(F.array_join(value, delimiter), F.lit(""))


def dot(left: Column, right: Column) -> Column:
    """Inner product of two numeric arrays."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    """Euclidean length of a numeric array."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit_vector(vector: Column) -> Column:
    """Array scaled to length 1; an all-zero array stays zero."""
    return let(vector, lambda v: let(norm(v), lambda length: F.transform(
        v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))))


def distance(left: Column, right: Column) -> Column:
    """Euclidean distance of two numeric arrays."""
    return F.sqrt(F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x * x))
