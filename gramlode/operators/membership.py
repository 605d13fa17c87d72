"""Membership tests that need no join: a filter for very many keys that lets a few others through, and an exact table for a
bounded number of forms. Both are arrays looked up by a hash, so a test costs the same whatever their number."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.session import stored

#: Longs of the largest filter (8 MB), and bits that a key gets. With these a filter lets about 4 % of the others through.
MOST_WORDS, BITS_A_KEY = 1 << 20, 10


class Bloom(NamedTuple):
    """A stored row with the filter's longs; a key has two bits in one of them."""

    row: DataFrame
    words: int

    def may_hold(self, *columns: Column | str) -> Column:
        """Whether the key of ``columns`` may be among those of the filter: never false for one that is.

        The longs are a scalar subquery, worked out once and read by every task like a constant.
        """
        place, mask = _place(self.words, *columns)
        return F.get(self.row.scalar(), place.cast("int")).bitwiseAND(mask) == mask


def _place(words: int, *columns: Column | str) -> tuple[Column, Column]:
    h = F.xxhash64(*columns)

    def bit(shift: int) -> Column:
        at = F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return h.bitwiseAND(words - 1), bit(32).bitwiseOR(bit(40))


def bloom_filter(keys: DataFrame, *columns: str) -> Bloom | None:
    """A filter of the distinct or repeated ``columns`` of ``keys``, a stored table. None when there are so many that the
    largest filter would let nearly everything through.

    Keys are combined in their tasks first; what comes together is at most one long a place, whatever the number of keys.
    """
    n = keys.count()
    words = 1 << max((n * BITS_A_KEY // 64).bit_length(), 4)
    if words > 4 * MOST_WORDS:
        return None
    words = min(words, MOST_WORDS)
    place, mask = _place(words, *columns)
    blank = keys.sparkSession.range(words).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("bits"))
    filled = keys.select(place.alias("place"), mask.alias("bits")).union(blank).groupBy("place").agg(F.bit_or("bits").alias("bits"))
    ordered = F.sort_array(F.collect_list(F.struct("place", "bits")))
    return Bloom(stored(filled.agg(F.transform(ordered, lambda x: x["bits"]).alias("longs")), "bloom"), words)


class Forms(NamedTuple):
    """Exact table of forms: buckets by hash, the forms of a bucket joined by a bar, a dash in an empty one. Forms
    have letters and spaces only."""

    buckets: list[str]

    def holds(self, form: Column) -> Column:
        table = F.split(F.lit(",".join(self.buckets)), ",")  # folded to an array once by the optimizer
        bucket = F.get(table, F.xxhash64(form).bitwiseAND(len(self.buckets) - 1).cast("int"))
        among = F.contains(F.concat(F.lit("|"), bucket, F.lit("|")), F.concat(F.lit("|"), form, F.lit("|")))
        return (bucket == form) | (F.contains(bucket, F.lit("|")) & among)


def hashed_forms(forms: DataFrame, column: str) -> Forms:
    """The table of a column's words and word pairs; whatever else it holds is in no cleaned text. The forms come to the
    driver, so check their size first."""
    plain = forms.select(F.col(column).alias("form")).where(F.col("form").rlike("^[a-z]+( [a-z]+)?$")).distinct()
    rows = plain.select("form", F.xxhash64("form").alias("h")).toArrow()
    size = 1 << max((2 * rows.num_rows - 1).bit_length(), 1)
    buckets: list[list[str]] = [[] for _ in range(size)]
    for form, h in zip(rows["form"].to_pylist(), rows["h"].to_pylist()):
        buckets[h & (size - 1)].append(form)
    return Forms(["|".join(sorted(bucket)) or "-" for bucket in buckets])
