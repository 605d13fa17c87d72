"""Size-checked joins with a small side."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: A value with this share of all rows is hot; counters that a task keeps to find them.
HOT_SHARE, TRACKED = 0.001, 16_384


def _row_bytes(df: DataFrame) -> Column:
    widths = [
        F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, T.StringType) else F.lit(8)
        for f in df.schema
    ]
    return functools.reduce(operator.add, widths)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is small enough to be copied to every executor, by counting it.

    The count is an aggregate over ``df``; give this a stored table, not a plan that is long to compute.
    """
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return n <= rows and total <= size


def heavy_hitters(rows: DataFrame, column: str, share: float = HOT_SHARE) -> list:
    """The values that hold at least ``share`` of the ``rows``, by a frequent-items summary that every task makes of its
    own rows and that are merged: a bounded number of counters and, at most ``1 / share`` values as result."""
    most = int(1 / share)
    n, top = rows.agg(F.count(column), F.expr(f"approx_top_k(`{column}`, {most}, {TRACKED})")).first()
    return [x["item"] for x in top or [] if x["item"] is not None and x["count"] >= n * share]


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    left: str,
    right: str,
    small: bool | None = None,
    hot: Sequence = (),
    may_hold: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Inner join of many ``rows`` with a look-up ``table`` on ``rows.left = table.right``; the key of the table is kept
    under the name of the rows' column.

    A table within the checked bound is broadcast, so the rows do not move. A larger one is split by ``hot``, the values
    that hold a large share of the rows: their part of the table is broadcast, if it is within the bound, and these rows do not move
    either; the others are joined by sort-merge, where no value has more than a small share of the rows left. ``may_hold``
    tells which values can be in the table at all; others are dropped before they move. Nothing of the table is repeated.
    """
    if small is None:
        small = fits_broadcast(table)
    named = table.withColumnRenamed(right, left)
    if small:
        return rows.join(F.broadcast(named), left)
    is_hot = F.col(left).isin(list(hot)) if hot else F.lit(False)
    if hot and not fits_broadcast(named.where(is_hot)):
        hot, is_hot = (), F.lit(False)
    rest = rows.where(~is_hot)
    if may_hold is not None:
        rest = rest.where(may_hold(left))
    # sort-merge on purpose: it spills and splits skewed partitions
    joined = rest.join(named.where(~is_hot).hint("merge"), left)
    return rows.where(is_hot).join(F.broadcast(named.where(is_hot)), left).unionByName(joined) if hot else joined
