"""Exact top-k search by inner product: columnar branch and bound.

Vectors are held dimension by dimension in blocks of a few thousand. For a query the distances grow by a block of
dimensions at a time; after each, a candidate whose sum so far plus the most that the remaining dimensions can add
(product of the remaining lengths, Cauchy-Schwarz) stays under the k-th best of the lower bounds is out, and the
survivors are compacted. All arithmetic is on integers below 2**53, so scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries packed into one row, and its bytes at most.
CANDIDATES, QUERIES, BLOCK_BYTES = 4096, 256, 16 << 20
#: Dimensions accumulated between two prunings.
STEP = 8


#: Components after scaling, so that sums of products are exact.
LARGEST = 2**20


def quantised(vector: str, scale: int = 256):
    """floor(scale * x) of every component, null when the vector is null or has a null or non-finite component. A
    component of 2**20 or more after scaling is an error."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    beyond = F.raise_error(F.lit(f"a component of {LARGEST} or more after scaling")).cast("long")
    whole = lambda v: F.when(F.abs(v * scale) < LARGEST, F.floor(v * scale).cast("long")).otherwise(beyond)
    return F.when(fine, F.transform(x, whole))


def _pack(size: int):
    """Rows ``id, v`` of a partition to blocks in vertical layout, one row each; vectors of other lengths apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dims: int) -> pa.RecordBatch:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dims)))
            return pa.record_batch(
                [pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(rows.T).tobytes()], pa.binary())],
                ["dims", "ids", "data"],
            )

        for batch in batches:
            lists = batch.column(1)
            lengths = np.asarray(lists.value_lengths())
            ids, flat = np.asarray(batch.column(0)), np.asarray(lists.flatten())
            first = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                rows = flat[first[at][:, None] + np.arange(dims)].astype(np.int32)
                most = max(1, min(size, BLOCK_BYTES // max(4 * int(dims), 1)))
                for i in range(0, len(at), most):
                    held.setdefault(int(dims), []).append((ids[at[i : i + most]], rows[i : i + most]))
                    if sum(len(x) for x, _ in held[int(dims)]) >= most:
                        yield flush(int(dims))
        for dims in list(held):
            yield flush(dims)

    return run


def tails(block: np.ndarray) -> np.ndarray:
    """Squared lengths of what is left of every candidate after each group of dimensions."""
    squares = [np.einsum("ij,ij->j", block[c : c + STEP], block[c : c + STEP]) for c in range(0, len(block), STEP)]
    return np.cumsum([np.zeros(block.shape[1]), *squares[::-1]], axis=0)[::-1][1:]


def best_of_block(
    query: np.ndarray, block: np.ndarray, rest: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float = -np.inf
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best of one block for one query; ``block`` is dimensions by candidates, ``rest`` its
    ``tails``. Candidates that cannot reach ``floor`` may be left out."""
    cuts = list(range(0, len(query), STEP))
    # lengths of what is left of the query from each cut on
    tail_q = np.array([np.dot(query[c:], query[c:]) for c in cuts] + [0.0])
    alive = np.flatnonzero(ids != own)
    sums = np.zeros(len(alive))
    for i, cut in enumerate(cuts):
        part = block[cut : cut + STEP][:, alive] if len(alive) < block.shape[1] else block[cut : cut + STEP]
        sums = sums + query[cut : cut + STEP] @ part
        if len(alive) > k or floor > -np.inf:
            reach = np.sqrt(rest[i][alive] * tail_q[i + 1]) * (1 + 1e-9) + 1e-6
            least = max(floor, np.partition(sums - reach, len(alive) - k)[len(alive) - k] if len(alive) > k else -np.inf)
            keep = sums + reach >= least
            alive, sums = alive[keep], sums[keep]
    order = np.lexsort((ids[alive], -sums))[:k]
    return ids[alive][order], sums[order]


def _search(k: int):
    """Rows ``slot, dims, asks, ids, data``, a slot's candidates before its queries, to the ``k`` best that a slot has for
    each query. A task holds the candidates of one slot and one block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            slots, lengths, asks = (batch.column(i).to_pylist() for i in range(3))
            for i, (slot, dims, asking) in enumerate(zip(slots, lengths, asks)):
                if (slot, dims) != at:
                    at, held = (slot, dims), []
                ids = np.frombuffer(batch.column(3)[i].as_buffer(), np.int64)
                block = np.frombuffer(batch.column(4)[i].as_buffer(), np.int32).reshape(dims, len(ids)).astype(np.float64)
                if not asking:
                    held.append((block, tails(block), ids.copy()))
                    continue
                out: tuple[list, list, list] = ([], [], [])
                for own, query in zip(ids, np.ascontiguousarray(block.T)) if held else ():
                    best, scores = np.zeros(0, np.int64), np.zeros(0)
                    for candidates, rest, names in held:
                        floor = scores[-1] if len(scores) == k else -np.inf
                        more, of = best_of_block(query, candidates, rest, names, own, k, floor)
                        best, scores = np.r_[best, more], np.r_[scores, of]
                        order = np.lexsort((best, -scores))[:k]
                        best, scores = best[order], scores[order]
                    out[0].append(np.full(len(best), own))
                    out[1].append(best)
                    out[2].append(scores.astype(np.int64))
                if out[0]:
                    yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in out], ["query_id", "id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, id, score``: for each row of ``queries`` its ``k`` highest integer inner products among all
    ``rows`` but those with its own id; ties go to the smaller id.

    Null ids and vectors that are null or hold a null or non-finite component take no part; vectors are compared with
    those of equal length only; an empty vector scores 0. A query with no other row gives no rows. Repeated ids are
    separate candidates; of queries with one id the one with the smallest vector asks. Components of 2**20 or more after
    scaling are an error.
    """

    def cleaned(side: DataFrame) -> DataFrame:
        clean = side.select(F.col(f"`{key}`").cast("long").alias("id"), quantised(f"`{vector}`", scale).alias("v"))
        return clean.where(F.col("id").isNotNull() & F.col("v").isNotNull())

    def packed(clean: DataFrame, size: int) -> DataFrame:
        return clean.mapInArrow(_pack(size), "dims int, ids binary, data binary")

    # every block of candidates lies in one slot and every block of queries is sent to all slots, so that the pairs of
    # blocks are dealt over the cluster; blocks meet inside the task, no row holds a pair of them
    slots = max(1, rows.count() // CANDIDATES)
    slot = F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int")
    blocks = packed(cleaned(rows), CANDIDATES).select(slot.alias("slot"), "dims", F.lit(False).alias("asks"), "ids", "data")
    asked = packed(cleaned(queries).groupBy("id").agg(F.min("v").alias("v")), QUERIES).select(
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "dims", F.lit(True).alias("asks"), "ids", "data"
    )
    placed = blocks.unionByName(asked).repartition(slots, "slot").sortWithinPartitions("slot", "dims", "asks")
    found = placed.mapInArrow(_search(k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
