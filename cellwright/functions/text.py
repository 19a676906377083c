"""Column expressions shared by transforms, detectors, finders and corrections.

All are built-in Spark functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def ustrip(c: Column) -> Column:
    """Strip Unicode whitespace at both ends (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def title_case(c: Column) -> Column:
    """Python ``str.title``: upper-case the first letter of every letter run."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))),
        "",
    )


def email_valid(c: Column) -> Column:
    return c.rlike(K.RE_EMAIL)


def phone_key(c: Column) -> Column:
    """Phone text with separators removed (the duplicate key and the format check input)."""
    return F.regexp_replace(c, K.RE_PHONE_SEPARATORS, "")


def phone_valid(c: Column) -> Column:
    cleaned = phone_key(c)
    return cleaned.rlike(K.RE_PHONE_DIGITS) & ~cleaned.rlike(K.RE_ALL_ZERO) & ~ustrip(c).rlike(K.RE_AREA_00)


def digit_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, K.RE_NON_DIGIT, ""))


def dup_key(c: Column, name: str) -> Column:
    """Normalised duplicate key: e-mail trimmed and lower-cased, phone digits only."""
    s = c.cast("string")
    if K.is_email_name(name):
        return F.lower(ustrip(s))
    if K.is_phone_name(name):
        return phone_key(s)
    return s


def first_by(value: Column, cond: Column, order: Column) -> Column:
    """Value of the first row in ``order`` where ``cond`` holds (null if none).

    ``min_by`` is a declarative aggregate: it combines partially on the map side,
    so the first-hit search never gathers rows in one task.
    """
    # ties on the order key are broken by the value itself, so the pick is repeatable
    return F.min_by(value, F.when(cond, F.struct(order.alias("o"), value.alias("v"))))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def py_str(c: Column, dtype) -> Column:
    """Text of a value as Python ``str`` would print it, for examples and suggestions."""
    from pyspark.sql import types as T
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")
