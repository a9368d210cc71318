"""Scalar column functions (X1-X16). All are built-in Spark expressions, so
they stay inside whole-stage codegen; literal maps are small fixed tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv

EPS = 1e-9


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


# X1
def safe_div(num: Column, den: Column) -> Column:
    """Null if either side is null or |den| < 1e-9."""
    return F.when(num.isNotNull() & den.isNotNull() & (F.abs(den) >= F.lit(EPS)), num / den)


# X2
def zero_div_null(num: Column, den: Column) -> Column:
    """Null if either side is null or den = 0 (``try_divide`` semantics)."""
    return F.when(num.isNotNull() & den.isNotNull() & (den != 0), num / den)


# X3
def winsorize(c: Column, lo: float | None, hi: float | None) -> Column:
    """Clip to fixed bounds, keeping null as null."""
    x = c
    if hi is not None:
        x = F.least(x, F.lit(float(hi)))
    if lo is not None:
        x = F.greatest(x, F.lit(float(lo)))
    return F.when(c.isNotNull(), x)


def out_of_bounds(c: Column, lo: float, hi: float) -> Column:
    return (c < F.lit(lo)) | (c > F.lit(hi))


# X5
def to_double(c: Column) -> Column:
    """Numeric coercion; text that does not parse becomes null."""
    return c.try_cast("double")


# X6
def fold_grade(c: Column, mode: str = "drop") -> Column:
    """Fold an agency grade to the 10-step scale.

    ``drop``: unmapped -> null (exact key). ``keep``: trim, unmapped kept.
    ``upper``: upper(trim) first, unmapped kept upper-cased."""
    m = _map(fv.RATING_NORMALIZE)
    if mode == "drop":
        return F.try_element_at(m, c)
    if mode == "keep":
        t = F.trim(c)
        return F.when(c.isNotNull(), F.coalesce(F.try_element_at(m, t), t))
    if mode == "upper":
        t = F.upper(F.trim(F.coalesce(c, F.lit(""))))
        return F.coalesce(F.try_element_at(m, t), t)
    raise ValueError(mode)


# X7
def grade_ordinal(c: Column, scale: list[str] | None = None) -> Column:
    """Position of a grade on the scale (0 = best); unknown -> 99."""
    scale = scale or fv.RATING_SCALE
    pos = F.array_position(F.array(*[F.lit(s) for s in scale]), c)
    return F.when(c.isNotNull() & (pos > 0), (pos - 1).cast("int")).otherwise(F.lit(fv.UNKNOWN_ORDINAL))


def grade_at(ordinal: Column, scale: list[str] | None = None) -> Column:
    scale = scale or fv.RATING_SCALE
    return F.try_element_at(F.array(*[F.lit(s) for s in scale]), (ordinal + 1).cast("int"))


def valid_grade(c: Column) -> Column:
    """Grade present and on the 10-step scale."""
    return F.coalesce(c.isin(fv.RATING_SCALE), F.lit(False))


# X8
def foreign_sector(c: Column, keep_unmapped: bool = False) -> Column:
    if keep_unmapped:
        return F.coalesce(F.try_element_at(_map(fv.FOREIGN_SECTOR_MAP_B), c), c)
    return F.coalesce(F.try_element_at(_map(fv.FOREIGN_SECTOR_MAP), c), F.lit(fv.SECTOR_OTHER))


# X9
def normalize_sector(c: Column) -> Column:
    """Exact -> case-insensitive -> ordered keyword substring -> ``Other``."""
    raw = F.trim(c)
    low = F.lower(raw)
    ci = {}
    for k, v in fv.SECTOR_NORMALIZE.items():
        ci.setdefault(k.lower(), v)  # first key in order wins
    kw = None
    for words, target in fv.SECTOR_KEYWORDS:
        cond = None
        for w in words:
            cond = low.contains(w) if cond is None else (cond | low.contains(w))
        kw = F.when(cond, F.lit(target)) if kw is None else kw.when(cond, F.lit(target))
    kw = kw.otherwise(F.lit(fv.SECTOR_OTHER))
    return F.when(c.isNull() | (raw == ""), F.lit(fv.SECTOR_OTHER)).otherwise(
        F.coalesce(F.try_element_at(_map(fv.SECTOR_NORMALIZE), raw),
                   F.try_element_at(_map(ci), low), kw))


# X10
def is_financial(sector: Column) -> Column:
    return F.coalesce(sector.isin(fv.FINANCIAL_SECTORS), F.lit(False))


# X11
def safe_str(c: Column) -> Column:
    """Null -> '', trimmed; for array input the first non-blank element."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def first_non_blank(arr: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.transform(arr, lambda x: F.trim(x)),
                                                lambda x: x != ""), F.lit(1)), F.lit(""))


# X12
def percent_to_ratio(c: Column, heuristic: bool = False) -> Column:
    """Always /100, or (parity) /100 only when |x| > 1."""
    if heuristic:
        return F.when(c.isNotNull() & (F.abs(c) > 1), c / 100.0).otherwise(c)
    return c / 100.0


# X13
def log_size(c: Column) -> Column:
    return F.log1p(F.abs(c))


def ln_positive(c: Column) -> Column:
    return F.when(c > 0, F.log(c))


# X14
def id_from_name(name: Column) -> Column:
    return F.replace(F.upper(F.substring(name, 1, 6)), F.lit(" "), F.lit(""))


# X15
def risk_band(grade: Column) -> Column:
    out = None
    for grades, band in fv.RISK_BANDS:
        cond = grade.isin(grades)
        out = F.when(cond, F.lit(band)) if out is None else out.when(cond, F.lit(band))
    return out.otherwise(F.lit(fv.RISK_BAND_DEFAULT))


# X16
def strip_parens(c: Column) -> Column:
    """Remove ``(...)`` groups with surrounding blanks, lower-case and trim."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s*\(.*?\)\s*", "")))
