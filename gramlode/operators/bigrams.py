"""Bigram counts over a corpus and candidates for synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.functions.text import bigram_rows, with_raw_tokens


def bigram_counts(docs: DataFrame, text: str) -> DataFrame:
    """``(bigram, count)`` over all texts; counted in each task first, so a frequent bigram moves one row per task."""
    return bigram_rows(with_raw_tokens(docs, [], text)).groupBy("bigram").count()


def most_frequent_first(counts: DataFrame) -> DataFrame:
    """Sorted by count, equal counts by bigram. Followed by ``limit(k)`` it is a top-k without a full sort."""
    return counts.orderBy(F.desc("count"), "bigram")


def count_of(counts: DataFrame, bigram: str) -> Column:
    """The count of one bigram as a scalar for use in other conditions; null when there is none."""
    return counts.where(F.col("bigram") == bigram).select("count").scalar()


def frequency_band(counts: DataFrame, base: str, threshold: float = 0.7) -> DataFrame:
    """Bigrams whose count is strictly between ``c * (1 - threshold)`` and ``c * (1 + threshold)``, ``c`` being the count
    of ``base``. An absent base gives no rows.

    ``counts`` is read twice, so give a stored table: the look-up and the band are then two filters on its scan.
    """
    c = count_of(counts, base).cast("double")
    low, high = F.lit(1.0 - threshold), F.lit(1.0 + threshold)
    return counts.where((F.col("count") < c * high) & (F.col("count") > c * low))


def synonym_candidates(counts: DataFrame, base: str, core: str, threshold: float = 0.7) -> DataFrame:
    """Bigrams in the frequency band of ``base`` that contain ``core``."""
    return frequency_band(counts, base, threshold).where(F.contains("bigram", F.lit(core)))
