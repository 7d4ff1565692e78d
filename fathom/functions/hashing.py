"""Layout-free pseudo-randomness from md5.

``rand(seed)`` depends on how rows are spread over partitions, so a job
re-run on another cluster would draw different numbers. Hashing a row key
gives the same draw wherever the row lands, and DuckDB's ``md5`` gives the
same hex, so every such draw can be repeated in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_POW_48 = float(2 ** 48)


def key_text(cols: list[Column | str]) -> Column:
    """Concatenate key columns as text with a '|' separator (null -> '')."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
             for c in cols]
    return F.concat_ws("|", *parts) if len(parts) > 1 else parts[0]


def order_hash(key: Column, seed: int) -> Column:
    """md5 hex of ``key || '|' || seed`` — the total order of splits/folds."""
    return F.md5(F.concat(key, F.lit(f"|{seed}")))


def hex_prefix_int(h: Column, start: int, length: int) -> Column:
    """Integer value of ``length`` hex digits of ``h`` starting at 1-based ``start``."""
    return F.conv(F.substring(h, start, length), 16, 10).cast("bigint")


def uniform(key: Column, salt: str) -> Column:
    """U(0,1) from the first 12 hex digits of md5(key || salt)."""
    h = F.md5(F.concat(key, F.lit(salt)))
    return hex_prefix_int(h, 1, 12).cast("double") / F.lit(TWO_POW_48)
