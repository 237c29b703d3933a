"""Random and positional splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollmill.operators.ordering import first_part
from tollmill.operators.sampling import row_key


def split_random(df: DataFrame, ratio: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two parts drawn by the digest of each row, so a row is always on the same side; equal rows stay together.

    The first twelve hex digits of the digest are a uniform number below 2^48.
    """
    first = F.conv(F.left(row_key(df.columns, seed), F.lit(12)), 16, 10).cast("bigint") < F.lit(int(ratio * (1 << 48)))
    return df.filter(first), df.filter(~first)


def split_head(df: DataFrame, key: str | list[str], ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first ``floor(n * ratio)`` rows in key order, and the rest. The key must be unique.

    The key at the cut is found by counting (``rank_cut``); the rows themselves are then divided
    by a plain comparison and never move.
    """
    keys = [key] if isinstance(key, str) else list(key)
    head = first_part(df, keys, ratio)
    return df.filter(head), df.filter(~head)
