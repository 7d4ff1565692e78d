"""Column expressions for statistics and presentation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def adjusted_skewness(c: Column | str) -> Column:
    """Bias-corrected sample skewness G1 as an aggregate expression.

    Spark's ``skewness`` is the population g1 = m3 / m2^1.5; the sample
    estimator multiplies it by sqrt(n(n-1))/(n-2). Fewer than three values
    or zero variance give 0.0 (Spark returns null for the latter).
    """
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return (F.when(n < 3, F.lit(0.0))
            .otherwise(F.coalesce(g1 * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))))


def numeric_text(c: Column, digits: int) -> Column:
    """Text of ``round(c, digits)`` the way Python prints a float.

    ``%.{d}f`` of the rounded value, with trailing zeros dropped but one
    digit kept after the point (``3.1000`` -> ``3.1``, ``3.0000`` -> ``3.0``).
    Null stays null; NaN and infinities print as Python does.
    """
    r = py_round(c, digits)
    fixed = F.format_string(f"%.{digits}f", r)
    trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")
    return (F.when(r.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(r), F.lit("nan"))
            .when(r == float("inf"), F.lit("inf"))
            .when(r == float("-inf"), F.lit("-inf"))
            .otherwise(trimmed))


def not_nan(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def py_round(c: Column, digits: int) -> Column:
    """``round`` that keeps the sign of a small negative, as Python does (-0.0)."""
    r = F.round(c, digits)
    negative = F.format_string("%e", c).startswith("-")   # also true for -0.0
    return F.when(negative & (r == 0), F.lit(-0.0)).otherwise(r)


#: What counts as a number in text: no type suffixes (``10d``) and no hexadecimal floats.
NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|nan|inf(?:inity)?)\s*$"


def number_or_null(c: Column, kind: str = "double") -> Column:
    """Text as a number where it is written as one, else null."""
    return F.when(c.rlike(NUMBER), c.try_cast(kind))
