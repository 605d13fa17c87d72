"""Hard-negative mining by segment summaries.

Every vector is stored with the mean and the deviation of its segments, in levels: one segment, then four, then sixteen.
Over a segment of ``n`` components an inner product lies within ``n * (mean * mean ± deviation * deviation)``, so sums
over segments bound a score from both sides. Candidates whose bounds cannot reach what an anchor needs are left out
level by level, finer segments only for those that are left; the rest are scored exactly, on whole numbers.

Rows lie in blocks of a few thousand, sorted by label, so that most blocks have one label; blocks are dealt to slots and
blocks of anchors go to every slot. A first search finds each anchor's positives, a second one its negatives.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlode.session import stored

#: Vectors and anchors packed into one row, and vectors of a slot.
ROWS, ANCHORS, SLOT = 4096, 256, 32_768
#: Segments of a level are cut into so many.
FAN = 4
#: Sums of products must fit a long: the largest component after scaling.
LARGEST = 2**24
SCALE = 256


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, null for a vector that is null or has a null or non-finite component. A
    component of 2**24 or more after scaling is an error: its scores might not fit a long."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v * scale) < LARGEST, F.floor(v * scale).cast("long")).otherwise(
        F.raise_error(F.lit(f"a component of {LARGEST} or more after scaling")).cast("long")
    )
    return F.when(fine, F.transform(x, whole))


def levels(dims: int) -> list[np.ndarray]:
    """Where the segments of each level begin: 1, 4, 16 segments and so on, while a segment has ``FAN`` components."""
    counts = [1]
    while counts[-1] * FAN * FAN <= dims:
        counts.append(counts[-1] * FAN)
    return [np.arange(n) * dims // n for n in counts] if dims else []


class Summary(NamedTuple):
    """Means and deviations, each times the root of the segment's length: segments by vectors."""

    mean: np.ndarray
    deviation: np.ndarray


def summaries(data: np.ndarray) -> list[Summary]:
    """The levels' summaries of vectors in columns."""
    out = []
    for begin in levels(len(data)):
        size = np.diff(begin, append=len(data))[:, None]
        sums, squares = (np.add.reduceat(x, begin, axis=0) for x in (data, data * data))
        out.append(Summary(sums / np.sqrt(size), np.sqrt(np.maximum(squares - sums * sums / size, 0.0))))
    return out


class Block(NamedTuple):
    row: np.ndarray  # a number of its own for every row
    id: np.ndarray
    label: np.ndarray
    data: np.ndarray  # components by rows, whole numbers
    levels: list[Summary]


BLOCK = "dims int, low long, high long, rows binary, ids binary, labels binary, data binary, summary binary"


def _packed(dims: int, row: np.ndarray, ids: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> list[pa.Array]:
    data = np.ascontiguousarray(vectors.T).reshape(dims, len(ids))
    parts = [x for level in summaries(data.astype(np.float64)) for x in level]
    summary = np.concatenate(parts).astype(np.float32) if parts else np.zeros(0, np.float32)
    held = (row.astype(np.int64), ids.astype(np.int64), label.astype(np.int64), data.astype(np.int32), summary)
    whole = [pa.array([int(x)], t) for x, t in ((dims, pa.int32()), (label.min(), pa.int64()), (label.max(), pa.int64()))]
    return whole + [pa.array([x.tobytes()], pa.binary()) for x in held]


def _unpacked(dims: int, rows: bytes, ids: bytes, labels: bytes, data: bytes, summary: bytes) -> Block:
    row, own, label = (np.frombuffer(x, np.int64) for x in (rows, ids, labels))
    flat, found, at = np.frombuffer(summary, np.float32).reshape(-1, len(row)), [], 0
    for begin in levels(dims):
        n = len(begin)
        found.append(Summary(flat[at : at + n].astype(np.float64), flat[at + n : at + 2 * n].astype(np.float64)))
        at += 2 * n
    return Block(row, own, label, np.frombuffer(data, np.int32).reshape(dims, len(row)).astype(np.float64), found)


def _pack(size: int, extra: str | None = None):
    """Rows ``id, label, v, part`` (or with a number already: ``row, id, label, v`` and a column that is kept as a list
    of binaries) to blocks of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        count: dict[int, int] = {}
        seen = 0

        def flush(dims: int) -> pa.RecordBatch:
            parts = held.pop(dims)
            count.pop(dims)
            row, ids, label, vectors = (np.concatenate(x) for x in list(zip(*parts))[:4])
            names = [c.split()[0] for c in BLOCK.split(", ")]
            out = _packed(dims, row, ids, label, vectors)
            if extra:
                out.append(pa.array([[x for part in parts for x in part[4]]], pa.list_(pa.binary())))
            return pa.RecordBatch.from_arrays(out, names + ([extra] if extra else []))

        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            column = lambda name: np.asarray(batch.column(at[name]))  # noqa: B023, E731
            lists = batch.column(at["v"])
            lengths = np.asarray(lists.value_lengths()).astype(np.int64)
            flat, first = np.asarray(lists.flatten()), np.cumsum(lengths) - lengths
            ids, label = column("id"), column("label")
            row = column("row") if "row" in at else (column("part").astype(np.int64) << 40) + seen + np.arange(len(ids))
            seen += len(ids)
            kept = batch.column(at[extra]).to_pylist() if extra else None
            for dims in np.unique(lengths).tolist():
                which = np.flatnonzero(lengths == dims)
                for i in range(0, len(which), size):
                    own = which[i : i + size]
                    vectors = flat[first[own][:, None] + np.arange(dims)].reshape(len(own), dims)
                    if count.get(dims, 0) + len(own) > size:
                        yield flush(dims)
                    held.setdefault(dims, []).append((row[own], ids[own], label[own], vectors, [kept[j] for j in own] if extra else None))
                    count[dims] = count.get(dims, 0) + len(own)
        for dims in list(held):
            yield flush(dims)

    return run


def _anchor_rows(every: int):
    """``row, id, label, v`` of the rows of blocks whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                row, ids, label = (np.frombuffer(block[x], np.int64) for x in ("rows", "ids", "labels"))
                own = np.flatnonzero(ids % every == 0)
                vectors = np.frombuffer(block["data"], np.int32).reshape(block["dims"], len(ids)).T[own].astype(np.int64)
                offsets = np.arange(len(own) + 1, dtype=np.int32) * block["dims"]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(vectors).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(row[own]), pa.array(ids[own]), pa.array(label[own]), lists], ["row", "id", "label", "v"])

    return run


def bounds(a: Summary, b: Summary) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest inner product of the vectors of ``a`` with those of ``b``. Summaries are stored with 24
    bits, which the room on either side allows for."""
    middle, width = a.mean.T @ b.mean, a.deviation.T @ b.deviation
    length = [np.sqrt((s.mean**2 + s.deviation**2).sum(axis=0)) for s in (a, b)]
    width += 1e-5 * np.outer(*length) + 1e-3
    return middle - width, middle + width


def survivors(anchors: Block, block: Block, allowed: np.ndarray, needed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Which of the ``allowed`` pairs (anchors by rows) are to be scored: level by level ``needed(low, high, alive)`` says
    which may still matter, and only columns with such a pair are looked at more finely."""
    alive, columns = allowed, np.arange(allowed.shape[1])
    for a, b in zip(anchors.levels, block.levels):
        low, high = bounds(a, Summary(b.mean[:, columns], b.deviation[:, columns]))
        alive = alive & needed(low, high, alive)
        some = alive.any(axis=0)
        alive, columns = alive[:, some], columns[some]
    out = np.zeros(allowed.shape, bool)
    out[:, columns] = alive
    return out


def scored(anchors: Block, block: Block, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Every anchor with pairs: its number, the rows' places, and exact scores, best first, ties by smaller id."""
    columns = np.flatnonzero(pairs.any(axis=0))
    largest = np.abs(anchors.data).max(initial=0) * np.abs(block.data).max(initial=0) * max(len(block.data), 1)
    a, b = anchors.data, block.data[:, columns]
    if largest >= 2**53:
        a, b = a.astype(np.int64), b.astype(np.int64)
    scores = (a.T @ b).astype(np.int64)
    for i in np.flatnonzero(pairs.any(axis=1)):
        own = np.flatnonzero(pairs[i, columns])
        order = own[np.lexsort((block.id[columns[own]], -scores[i, own]))]
        yield int(i), columns[order], scores[i, order]


def best_positives(anchors: Block, block: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The ``k`` best rows of an anchor's own label in a block, itself excepted."""
    allowed = (anchors.label[:, None] == block.label) & (anchors.row[:, None] != block.row)

    def needed(low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        if low.shape[1] <= k:
            return alive
        floor = np.partition(np.where(alive, low, -np.inf), low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        return high >= floor[:, None]

    for i, places, scores in scored(anchors, block, survivors(anchors, block, allowed, needed)):
        yield i, places[:k], scores[:k]


def best_negatives(
    anchors: Block, block: Block, positives: list[np.ndarray], k: int, least: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For every anchor and place of its ``positives`` (their scores): the ``k`` best rows of other labels in a block whose
    score is at most the positive's and at least ``least`` hundredths of it."""
    allowed = anchors.label[:, None] != block.label
    highest = np.array([p.max(initial=-(2**62)) for p in positives], np.float64)[:, None]
    lowest = np.array([(-(-least * p // 100)).min(initial=2**62) for p in positives], np.float64)[:, None]

    def needed(low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        return (high >= lowest) & (low <= highest)

    for i, places, scores in scored(anchors, block, survivors(anchors, block, allowed, needed)):
        for j, positive in enumerate(positives[i].tolist()):
            first = int(np.searchsorted(-scores, -positive))
            own = slice(first, first + k)
            stays = 100 * scores[own] >= least * positive
            if stays.any():
                yield i, j, places[own][stays], scores[own][stays]


def _sides(pair: dict) -> tuple[Block, Block]:
    names = ("rows", "ids", "labels", "data", "summary")
    return tuple(_unpacked(pair["dims"], *(pair[prefix + name] for name in names)) for prefix in ("a_", ""))


def _found(names: list[str], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts)], names)


def _find_positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in (pair for batch in batches for pair in batch.to_pylist()):
            anchors, block = _sides(pair)
            out = []
            for i, places, scores in best_positives(anchors, block, k):
                out.append([np.full(len(places), anchors.row[i]), block.row[places], block.id[places], scores])
            if out:
                yield _found(["row", "other", "id", "score"], out)

    return run


def _find_negatives(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in (pair for batch in batches for pair in batch.to_pylist()):
            anchors, block = _sides(pair)
            known = [np.frombuffer(x, np.int64) for x in pair["positives"]]
            out = []
            for i, j, places, scores in best_negatives(anchors, block, known, k, least):
                out.append([np.full(len(places), anchors.row[i]), np.full(len(places), j, np.int32), block.id[places], scores])
            if out:
                yield _found(["row", "place", "id", "score"], out)

    return run


def _score_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, id, label, v, found`` with the scores of ``found`` as one binary."""
    for batch in batches:
        scores = [np.array([x["score"] for x in found], np.int64).tobytes() for found in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.binary())], ["row", "id", "label", "v", "positives"])


def mine(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. An anchor's positives are its best other rows of the same
    label; for each, the best rows of other labels that score at most as the positive does and at least ``least``
    hundredths of it. Scores are integer inner products of ``floor(scale * x)``, ties go to the smaller id.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part; labels are whole numbers.
    Vectors are compared with those of equal length only; empty ones score 0. Repeated rows are rows of their own: each
    is an anchor if its id makes it one, and the other copies are candidates. No rows give no rows. Other columns are not
    looked at. Components of 2**24 or more after scaling are an error.
    """
    whole = rows.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{label}`").cast("long").alias("label"),
        quantised(F.col(f"`{vector}`"), scale).alias("v"),
    )
    clean = whole.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    spark = rows.sparkSession
    n = rows.count()
    slots = max(math.ceil(n / SLOT), min(spark.sparkContext.defaultParallelism, math.ceil(n / 1024)), 1)
    # by label, and within a label by a number of the row, so that one label, or one row repeated, may have most rows
    dealt = clean.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(slots, "label", "deal")
    sorted_rows = dealt.sortWithinPartitions("label", "deal").select("id", "label", "v", F.spark_partition_id().alias("part"))
    blocks = stored(sorted_rows.mapInArrow(_pack(ROWS), BLOCK), "vector-blocks")
    placed = blocks.withColumn("slot", F.pmod(F.xxhash64("rows"), F.lit(slots)).cast("int"))
    anchors = stored(blocks.mapInArrow(_anchor_rows(every), "row long, id long, label long, v array<long>"), "anchors")

    def meet(packed: DataFrame, met: Callable[[], Column], more: tuple[str, ...] = ()) -> DataFrame:
        asked = packed.select("dims", *(F.col(c).alias(f"a_{c}") for c in packed.columns if c not in ("dims", *more)), *more)
        copies = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        return placed.hint("merge").join(copies, ["slot", "dims"]).where(met()).drop("slot", "low", "high", "a_low", "a_high")

    # blocks have a range of labels: those that cannot hold a positive, or a negative, do not meet
    met = meet(anchors.mapInArrow(_pack(ANCHORS), BLOCK), lambda: (F.col("a_low") <= F.col("high")) & (F.col("a_high") >= F.col("low")))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id", "other")
    found = met.mapInArrow(_find_positives(positives), "row long, other long, id long, score long")
    ranked = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    listed = ranked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    known = stored(anchors.join(listed, "row").select("row", "id", "label", "v", "found"), "positives")
    packed = known.mapInArrow(_score_list, "row long, id long, label long, v array<long>, positives binary")
    met = meet(
        packed.mapInArrow(_pack(ANCHORS, "positives"), f"{BLOCK}, positives array<binary>"),
        lambda: ~((F.col("low") == F.col("high")) & (F.col("a_low") == F.col("a_high")) & (F.col("low") == F.col("a_low"))),
        ("positives",),
    )
    best = Window.partitionBy("row", "place").orderBy(F.desc("score"), "id")
    hard = met.mapInArrow(_find_negatives(negatives, least), "row long, place int, id long, score long")
    hard = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    names = known.select("row", F.col("id").alias("anchor_id"), F.posexplode("found").alias("place", "p"))
    return hard.join(names, ["row", "place"]).select(
        "anchor_id",
        F.col("p.id").alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
