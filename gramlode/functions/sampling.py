"""Repeatable row sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_sample(p: float, *columns: str) -> Column:
    """True for a fraction ``p`` of the rows, always the same ones.

    The first 32 bits of the md5 over the key columns are compared with ``p`` as lower-case hex, so another engine can
    pick the same rows. No state, no shuffle, and a recomputed task picks what the lost one picked.
    """
    if p >= 1:
        return F.lit(True)
    bound = format(int(p * 2**32), "08x")
    return F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8) < F.lit(bound)
