"""Text to number under the two input policies, and the start command's integer rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# \z and not $: the latter would also match before a final line break.
_SPACE = r"[ \t\n\x0b\f\r]*"
_INTEGER = r"[+-]?[0-9]+"
_DECIMAL = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def strict_int(text: Column, kind: str = "int") -> Column:
    """Sign and digits only, in range; anything else is null. Spark's own cast would also trim."""
    return F.when(text.rlike(rf"^{_INTEGER}\z"), text.try_cast(kind))


def strict_float(text: Column) -> Column:
    """Decimal text with an optional f or d suffix. Spark's cast would also take ``inf`` and ``nan``."""
    number = text.try_cast("float")
    special = text.rlike(r"(?i)^\s*[+-]?(inf|infinity|nan)\s*\z") & ~text.rlike(r"^\s*[+-]?(NaN|Infinity)\s*\z")
    return F.when(~special, number)


def _affinity(text: Column) -> tuple[Column, Column, Column]:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return bare, text.rlike(rf"^{_SPACE}{_INTEGER}{_SPACE}\z"), text.rlike(rf"^{_SPACE}{_DECIMAL}{_SPACE}\z")


def lenient_int(text: Column, kind: str = "int") -> Column:
    """Column affinity of an integer column: integral decimals convert, other text does not."""
    bare, is_integer, is_decimal = _affinity(text)
    real = bare.try_cast("double")
    integral = F.when((real == F.floor(real)) & (F.abs(real) < F.lit(float(2**63))), real.try_cast("bigint"))
    return F.when(is_integer, bare.try_cast(kind)).when(is_decimal, integral.try_cast(kind))


def lenient_float(text: Column) -> Column:
    bare, _, is_decimal = _affinity(text)
    return F.when(is_decimal, bare.try_cast("float"))


def leading_int(text: Column) -> Column:
    """Leading integer after optional blanks, else 0. Out of range counts as not a number."""
    digits = F.regexp_extract(text, r"^[ \t\n\x0b\f\r]*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def digits_only(text: Column) -> Column:
    return text.rlike(r"^[0-9]*\z")
