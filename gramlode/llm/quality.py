"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text with feature vector x is the logistic of ``b + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2
x_i^2)``: all pairwise interactions of low rank in time linear in the features. It is trained with numpy on a bounded
sample of labelled rows; every text is scored whole, in Arrow batches, where Spark has placed it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gramlode.llm.common import give_back
from gramlode.llm.tokens import LOWER, Hasher, blocks

#: Buckets of hashed words, rank of the interactions, labelled rows that a model is fitted on at most.
BUCKETS, RANK, SAMPLE = 1 << 14, 8, 6000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.03, 1e-4
#: Structure statistics (see ``_statistics``) and one piece of metadata, the recorded length.
STATS = 16

_CODE = np.arange(256)
_ASCII = [chr(b) for b in range(128)]


def _bytes(test: Callable[[str], bool]) -> np.ndarray:
    return np.array([b < 128 and test(chr(b)) for b in range(256)])


#: Kinds of bytes that are counted in every text.
_KINDS = np.stack([
    _bytes(str.isupper), _bytes(str.islower), _bytes(str.isdigit), _bytes(lambda c: c in ".,;:'\"()-?"),
    _bytes(lambda c: c == "!"), _bytes(lambda c: c in "|"), _bytes(lambda c: c in "#$%&*@^~=+<>{}[]\\/_"), _bytes(lambda c: c == "\n"),
    _CODE >= 128,
])
_ONE_KIND = np.where(_KINDS.any(0), _KINDS.argmax(0), len(_KINDS)).astype(np.uint8)


class Features(NamedTuple):
    """Hashed word counts of texts, by row, and their statistics."""

    row: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    stats: np.ndarray


def features(column: pa.Array, lengths: np.ndarray) -> Features:
    """Of every row of a text column; ``lengths``: the recorded lengths, NaN if there are none."""
    n = len(column)
    raw = np.zeros((n, len(_KINDS) + 4))  # kinds of bytes, then bytes, words, repeats, capitalised words
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for block in blocks(column, lower=False):
        low = LOWER[block.data]
        h = Hasher(low).spans(block.begin, block.end)
        row = block.rows[block.piece]
        key = row * BUCKETS + (h >> np.uint64(50)).astype(np.int64)
        parts.append(np.unique(key, return_counts=True))
        at = np.repeat(block.rows, block.sizes)
        kinds = np.bincount((at - block.rows[0]) * (len(_KINDS) + 1) + _ONE_KIND[block.data], minlength=(block.rows[-1] - block.rows[0] + 1) * (len(_KINDS) + 1))
        span = slice(block.rows[0], block.rows[-1] + 1)
        raw[span, : len(_KINDS)] += kinds.reshape(-1, len(_KINDS) + 1)[:, :-1]
        np.add.at(raw[:, len(_KINDS)], block.rows, block.sizes - 1)
        if len(row):
            again = np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])]
            np.add.at(raw[:, len(_KINDS) + 1], row, 1)
            np.add.at(raw[:, len(_KINDS) + 2], row[again], 1)
            np.add.at(raw[:, len(_KINDS) + 3], row[low[block.begin] != block.data[block.begin]], 1)
    keys, counts = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(parts) > 1 and len(keys):  # a long text's pieces share buckets
        keys, inverse = np.unique(keys, return_inverse=True)
        counts = np.bincount(inverse, counts)
    row = keys // BUCKETS
    distinct = np.bincount(row, minlength=n)
    return Features(row, keys % BUCKETS, counts, _statistics(raw, distinct, lengths))


def _statistics(raw: np.ndarray, distinct: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    k = len(_KINDS)
    size, words = np.maximum(raw[:, k], 1), np.maximum(raw[:, k + 1], 1)
    shares = raw[:, :k] / size[:, None]
    letters = np.maximum(raw[:, 0] + raw[:, 1], 1)
    recorded = np.where(np.isfinite(lengths), lengths, raw[:, k])
    return np.column_stack([
        np.sqrt(shares), raw[:, 0] / letters, raw[:, k + 2] / words, raw[:, k + 3] / words, distinct / words,
        np.minimum(size / words, 40) / 10, np.log1p(raw[:, k + 1]) / 5, np.log1p(np.maximum(recorded, 0)) / 5,
    ])


class Machine(NamedTuple):
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _vectors(f: Features, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the vectors: log counts of unit length, then the standardised statistics."""
    n = len(f.stats)
    x = np.log1p(f.count)
    norm = np.sqrt(np.bincount(f.row, x * x, minlength=n))
    stats = np.clip((f.stats - mean) / scale, -4, 4)
    return (
        np.r_[f.row, np.repeat(np.arange(n), STATS)],
        np.r_[f.bucket, np.tile(BUCKETS + np.arange(STATS), n)],
        np.r_[x / np.maximum(norm[f.row], 1e-9), stats.ravel()],
    )


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(row, values[:, j], minlength=n) for j in range(values.shape[1])])


def scores(m: Machine, f: Features) -> np.ndarray:
    """Probability of label 1 for every row."""
    n = len(f.stats)
    row, at, x = _vectors(f, m.mean, m.scale)
    vx = m.v[at] * x[:, None]
    s = _sums(row, vx, n)
    squares = np.bincount(row, (vx * vx).sum(1), minlength=n)
    z = m.bias + np.bincount(row, m.w[at] * x, minlength=n) + 0.5 * ((s * s).sum(1) - squares)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(f: Features, y: np.ndarray, seed: int = 7) -> Machine:
    """Adam on the logistic loss, classes weighted evenly half way. With one class, or no rows, its share is the score."""
    n, size = len(y), BUCKETS + STATS
    rng = np.random.default_rng(seed)
    mean = f.stats.mean(0) if n else np.zeros(STATS)
    scale = f.stats.std(0) + 1e-3 if n else np.ones(STATS)
    share = (y.sum() + 1) / (n + 2)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, RANK))
    if n < 2 or y.min() == y.max():
        return Machine(bias, w, v, mean, scale)
    v = rng.normal(0, 0.01, (size, RANK))
    weight = np.where(y > 0, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
    row, at, x = _vectors(f, mean, scale)
    order = np.argsort(row, kind="stable")
    row, at, x = row[order], at[order], x[order]
    first = np.searchsorted(row, np.arange(n + 1))
    state = [np.zeros((2, *p.shape)) for p in (w, v)] + [np.zeros(2)]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 3)
        for rows in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            step += 1
            take = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            r = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
            i, xi = at[take], x[take]
            vx = v[i] * xi[:, None]
            s = _sums(r, vx, len(rows))
            z = bias + np.bincount(r, w[i] * xi, minlength=len(rows)) + 0.5 * ((s * s).sum(1) - np.bincount(r, (vx * vx).sum(1), minlength=len(rows)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            used, place = np.unique(i, return_inverse=True)
            gw = np.bincount(place, g[r] * xi) + DECAY * w[used]
            gv = _sums(place, (g[r] * xi)[:, None] * (s[r] - vx), len(used)) + DECAY * v[used]
            for p, grad, held in ((w, gw, state[0]), (v, gv, state[1])):
                held[0][used] = 0.9 * held[0][used] + 0.1 * grad
                held[1][used] = 0.99 * held[1][used] + 0.01 * grad * grad
                p[used] -= rate * held[0][used] / (np.sqrt(held[1][used]) + 1e-6)
            state[2] = np.array([0.9, 0.99]) * state[2] + np.array([0.1, 0.01]) * np.array([g.sum(), g.sum() ** 2])
            bias -= rate * state[2][0] / (np.sqrt(state[2][1]) + 1e-6)
    return Machine(bias, w, v, mean, scale)


def labelled_ids(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """``doc_id, _label`` of the ids that have exactly one known label and for which ``learn`` holds."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(
        F.min(label).alias("_low"), F.max(label).alias("_high")
    )
    return known.where("_low = _high").select("doc_id", F.col("_low").alias("_label"))


def first_ids(known: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` of them, the first by a hash of the id."""
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, columns: list[str], bound: int = SAMPLE) -> DataFrame:
    """``columns`` and ``label`` of at most ``bound`` rows of ``docs`` whose id has exactly one known label and for which
    ``learn`` holds, the first by a hash of the id. A text that occurs under several ids counts each time."""
    chosen = first_ids(labelled_ids(labels, label, learn), bound)
    return docs.join(F.broadcast(chosen), "doc_id").select(*columns, F.col("_label").alias(label))


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that what is worked out for its words stays small."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _inputs(batch: pa.RecordBatch, first: int = 0) -> Features:
    return features(batch.column(first), batch.column(first + 1).cast(pa.float64()).to_numpy(zero_copy_only=False))


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        f = _inputs(batch)
        cuts = np.searchsorted(f.row, np.arange(len(f.stats) + 1))
        lists = lambda x, t: pa.array([x[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.list_(t))  # noqa: E731, B023
        yield pa.record_batch([lists(f.bucket, pa.int32()), lists(f.count, pa.int32()), pa.array(list(f.stats), pa.list_(pa.float64())), batch.column(2).cast(pa.int32())], ["bucket", "n", "stats", "y"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the sample to the machine, its arrays as bytes."""
    rows = list(batches)
    rows = pa.Table.from_batches(rows).combine_chunks() if rows else []
    lists = [np.asarray(rows["bucket"].combine_chunks().flatten(), np.int64), np.asarray(rows["n"].combine_chunks().flatten(), np.int64)] if len(rows) else [np.zeros(0, np.int64)] * 2
    lengths = np.asarray(rows["bucket"].combine_chunks().value_lengths()) if len(rows) else np.zeros(0, np.int64)
    stats = np.asarray(rows["stats"].combine_chunks().flatten()).reshape(-1, STATS) if len(rows) else np.zeros((0, STATS))
    f = Features(np.repeat(np.arange(len(lengths)), lengths), *lists, stats)
    # the sample comes in the order of the tasks; the same rows in another order would train another model
    y = np.asarray(rows["y"], np.float64) if len(rows) else np.zeros(0)
    del rows, lists
    machine = train(*_ordered(f, y))
    del f, y
    yield pa.record_batch([pa.array([machine.bias]), *(pa.array([x.tobytes()], pa.binary()) for x in machine[1:])], list(Machine._fields))
    give_back()


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> Machine:
    """Train on a bounded sample of the labelled rows for which ``learn`` holds. A task trains, so that the driver holds
    the machine only and not the sample."""
    sample = labelled_sample(docs, labels, label, learn, ["text", F.col("n_chars").cast("double").alias("n_chars")])
    rows = sample.mapInArrow(_collect_features, "bucket array<int>, n array<int>, stats array<double>, y int").repartition(1)
    row = rows.mapInArrow(_trained, "bias double, w binary, v binary, mean binary, scale binary").first()
    if row is None:  # a plan that is known to have no rows has no task either
        return train(Features(*[np.zeros(0, np.int64)] * 3, np.zeros((0, STATS))), np.zeros(0))
    w, v, mean, scale = (np.frombuffer(x) for x in row[1:])
    return Machine(row.bias, w, v.reshape(-1, RANK), mean, scale)


def _ordered(f: Features, y: np.ndarray) -> tuple[Features, np.ndarray]:
    n = len(y)
    order = np.lexsort((*f.stats.T, y)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    row = rank[f.row]
    place = np.lexsort((f.bucket, row))
    return Features(row[place], f.bucket[place], f.count[place], f.stats[order]), y[order]


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``_score``, the probability of label 1 of every whole text. A null or empty text
    is scored by its statistics alone; a missing length counts as the text's own. No rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Machine(*shared.value)
        for batch in (part for whole in batches for part in slices(whole)):
            k = batch.num_columns - 2
            yield pa.record_batch([*batch.columns[:k], pa.array(scores(held, _inputs(batch, k)))], [*batch.schema.names[:k], "_score"])
        give_back()

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("_text"), F.col("n_chars").cast("double").alias("_chars"))
    kept = rows.select(*(F.col(f"`{c}`") for c in keep))
    return rows.mapInArrow(run, StructType([*kept.schema.fields, StructField("_score", DoubleType())]))
