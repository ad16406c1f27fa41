"""Numbers: rounding, growth, units in millions, printed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A figure below this is too common in any text to prove anything.
MIN_ANCHOR = 100
THOUSANDS = r"(?i)'000|’000|\b(?:thousands?|000s|k)\b"
BILLIONS = r"(?i)\b(?:billions?|bn|b)\b"
MILLIONS = r"(?i)\b(?:millions?|mn|mm|m)\b"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_printed(x: Column | str, places: int = 2) -> Column:
    """Rounded as it prints: by the exact binary value, halves to even, no negative zero; infinities give null."""
    return F.replace(F.format_number(_c(x), places), F.lit(","), F.lit("")).try_cast("double") + F.lit(0.0)


def pct_change(current: Column | str, prior: Column | str) -> Column:
    """Percentage change on the size of the prior value, to 2 places; null where either is null or the prior is 0."""
    c, p = _c(current), _c(prior)
    return round_printed(F.when(p != 0, (c - p) / F.abs(p) * 100))


def scale_factor(label: Column | str) -> Column:
    """What turns a figure printed under the label into millions; null where the label isn't recognised."""
    u = _c(label)
    return F.when(u.rlike(THOUSANDS), 1e-3).when(u.rlike(BILLIONS), 1e3).when(u.rlike(MILLIONS), 1.0)


def printed_forms(x: Column) -> Column:
    """How a figure may be typeset, without its sign: whole numbers with and without separators, others to one and
    two places with and without."""
    v = F.abs(x)
    whole, one, two = F.format_number(v, 0), F.format_number(v, 1), F.format_number(v, 2)
    bare = [F.replace(f, F.lit(","), F.lit("")) for f in (whole, one, two)]
    near = F.abs(v - F.rint(v)) < 0.005
    return F.when(near, F.array(whole, bare[0])).otherwise(F.array(one, two, bare[1], bare[2]))


def anchored(form: Column, text: Column) -> Column:
    """Whether the form stands in the text as a figure of its own, not as a part of a longer one."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\d,.])"), F.replace(form, F.lit("."), F.lit(r"\.")), F.lit(r"(?![\d,.])")))


def any_anchored(x: Column, text: Column) -> Column:
    return F.exists(printed_forms(x), lambda f: anchored(f, text))


def num_close(actual: Column, expected: Column, rel: float = 0.02, absolute: float = 0.05) -> Column:
    """Equal within a tolerance; two nulls are equal, one is not."""
    near = F.abs(actual - expected) <= F.greatest(F.lit(absolute), F.abs(expected) * rel)
    return F.when(actual.isNull() | expected.isNull(), actual.isNull() & expected.isNull()).otherwise(near)


def fmt_money(x: Column | str) -> Column:
    return F.coalesce(F.format_number(_c(x), 1), F.lit("—"))


def fmt_pct(x: Column | str) -> Column:
    v = _c(x)
    bare = F.replace(F.format_number(v, 1), F.lit(","), F.lit(""))
    return F.coalesce(F.concat(F.when(v >= 0, "+").otherwise(""), bare, F.lit("%")), F.lit("—"))
