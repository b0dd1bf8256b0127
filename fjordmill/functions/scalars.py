"""Column functions: coercions, ratios, text markers. All of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What people write for nothing, in lower case.
PLACEHOLDERS = ("", "-", "--", "–", "—", ".", "?", "na", "n/a", "n.a.", "nan", "none", "null", "nil", "unknown", "undefined", "not available", "tbd", "#n/a")


def squeezed(text: Column) -> Column:
    """Lower case without outer blanks of any kind."""
    return F.lower(F.regexp_replace(text, r"^[\s ]+|[\s ]+$", ""))


def is_placeholder(text: Column) -> Column:
    """True for null, blank and the markers for nothing."""
    return text.isNull() | squeezed(text).isin(*PLACEHOLDERS)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def to_number(text: Column) -> Column:
    """A double, null for blank, unreadable, infinite and not-a-number."""
    n = blank_to_null(text.cast("string")).try_cast("double")
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def to_bool(text: Column, true=("1", "true", "yes")) -> Column:
    """False unless the text is one of the given spellings of true."""
    return F.coalesce(squeezed(text.cast("string")).isin(*true), F.lit(False))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))


def safe_divide(a: Column, b: Column, empty=None) -> Column:
    """a / b; where b is 0 or null the given value (null, 0.0 or nan)."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(empty).cast("double")).otherwise(a / b)


def nonzero_first(*columns: Column) -> Column:
    """The first value that is neither null nor 0, else 0.0."""
    return F.coalesce(*(F.nullif(c, F.lit(0.0)) for c in columns), F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean by weight over the rows with a value; the plain mean where the weights sum to 0."""
    w = F.when(value.isNotNull(), F.coalesce(weight, F.lit(0.0)))
    return F.when(F.coalesce(F.sum(w), F.lit(0.0)) != 0, F.sum(value * w) / F.sum(w)).otherwise(F.avg(value))


def sorted_join(column: Column, sep: str = ",") -> Column:
    """Aggregate: the distinct values, sorted, in one string."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def reason_map(names: Column) -> Column:
    """Aggregate helper: counts of (name, n) structs as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(names))))
