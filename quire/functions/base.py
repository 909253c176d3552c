"""Rules shared by every expression: white space, rounding, folding, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed_values as fv


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(fv.WS_CHARS))


def js_trim_start(c: Column) -> Column:
    return F.regexp_replace(c, f"^{fv.WS}+", "")


def js_trim_end(c: Column) -> Column:
    return F.regexp_replace(c, rf"{fv.WS}+\z", "")


def squash(c: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(c, f"{fv.WS}+", " ")


def js_round(c: Column, digits: int = 0) -> Column:
    """Half-up towards plus infinity."""
    if digits == 0:
        return F.floor(c + F.lit(0.5))
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ascii_fold(c: Column) -> Column:
    """Lower-case ASCII only: every character keeps its position."""
    return F.translate(c, fv.ASCII_UPPER, fv.ASCII_LOWER)


def or_else(c: Column, *others: Column) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (c, *others)])


def clip(c: Column, size: int) -> Column:
    return F.when(F.char_length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit(fv.ELLIPSIS))).otherwise(c)


def flat_cell(c: Column) -> Column:
    """Text fit for a ``|``-separated catalogue cell."""
    return js_trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[|{fv.WS_SET}]+", " "))


def clip_cell(c: Column, size: int) -> Column:
    return clip(flat_cell(c), size)


def line_count(c: Column) -> Column:
    """Lines, a run of line feeds counting as one break; blank text has none."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(c, "\n+", -1)))


def upper_median(values: Column, default: float) -> Column:
    """Middle value, the upper one of two; ``default`` for an empty array."""
    ordered = F.array_sort(values)
    return F.coalesce(F.try_element_at(ordered, (F.floor(F.size(values) / 2) + 1).cast("int")), F.lit(default))


def parse_tags(c: Column) -> Column:
    """JSON array of strings; anything else is an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
