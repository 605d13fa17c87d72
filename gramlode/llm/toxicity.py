"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word (run of letters and digits, lower-cased) is embedded as the sum of three rows of one hashed table: of the word
itself and of its first four and five bytes, so that inflected forms share what they have in common. Filters of several
widths slide over the words, the largest response of each goes to a logistic output. Everything is numpy: training by
back propagation through the maxima on a bounded sample of labelled rows, scoring in Arrow batches over whole texts.
The score does not know the language; the thresholds of the decision are calibrated for each language, over all
labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gramlode.llm.common import give_back
from gramlode.llm.quality import first_ids, slices
from gramlode.llm.tokens import NOT_LETTERS, Hasher, blocks
from gramlode.session import stored

TABLE, DIM = 1 << 16, 12
WIDTHS, FILTERS = (1, 2, 3), 6
#: Labelled rows of either label that a model is fitted on at most; words of one of them that training looks at at once.
SAMPLE = 2500
EPOCHS, BATCH, RATE = 8, 32, 0.02
PREFIXES = (4, 5)
#: Score bins to a unit of log odds; most labelled ids that are sent to every task.
BINS, MOST_BROADCAST = 100, 1 << 20
_CHUNK = 1 << 16
#: (width index, offset) of every slice of every filter.
_SLICES = [(k, j) for k, w in enumerate(WIDTHS) for j in range(w)]
OUT = len(WIDTHS) * FILTERS


class Net(NamedTuple):
    table: np.ndarray  # TABLE x DIM
    filters: np.ndarray  # slices x DIM x FILTERS
    shift: np.ndarray  # OUT
    out: np.ndarray  # OUT
    bias: float


def word_ids(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``row`` and the three table rows of each word, block by block. A window does not reach over the cuts that texts
    above the block size are given."""
    for block in blocks(column, between=NOT_LETTERS):
        hasher = Hasher(block.data)
        ends = [block.end, *(np.minimum(block.begin + p, block.end) for p in PREFIXES)]
        ids = [(hasher.spans(block.begin, e) ^ np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(48) for i, e in enumerate(ends)]
        yield block.rows[block.piece], np.stack(ids, 1).astype(np.int32)


def _pooled(net: Net, projected: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest response of each filter for runs of words that begin at ``first``; zero where no response is
    positive. ``projected`` is the table times the filters; a run's end is padded with zeros."""
    e = projected[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        e += projected[ids[:, k]]
    n = len(ids)
    last = np.zeros(n, bool)
    last[np.r_[first[1:], n] - 1] = True
    out = []
    for k, width in enumerate(WIDTHS):
        slices = [i for i, (w, _) in enumerate(_SLICES) if w == k]
        response = e[:, slices[0] * FILTERS : (slices[0] + 1) * FILTERS].copy()
        stop = last
        for j in range(1, width):
            part = e[j:, slices[j] * FILTERS : (slices[j] + 1) * FILTERS]
            response[:-j] += np.where(stop[:-j, None], 0, part)
            stop = stop | np.r_[last[j:], np.ones(j, bool)]
        out.append(np.maximum.reduceat(response, first, axis=0))
    return np.maximum(np.concatenate(out, 1) + net.shift, 0)


def project(net: Net) -> np.ndarray:
    out = np.empty((len(net.table), len(_SLICES) * FILTERS), np.float32)
    for i in range(len(_SLICES)):
        out[:, i * FILTERS : (i + 1) * FILTERS] = net.table @ net.filters[i]
    return out


def scores(net: Net, projected: np.ndarray, column: pa.Array) -> np.ndarray:
    """Probability of label 1 of every whole text; a text without words gets the score of no response at all."""
    best = np.zeros((len(column), OUT))
    reach = max(WIDTHS) - 1
    for row, ids in word_ids(column):
        for a in range(0, len(row), _CHUNK):
            # chunks overlap by what a window reaches, so that no window is missed
            r, x = row[a : a + _CHUNK + reach], ids[a : a + _CHUNK + reach]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            np.maximum.at(best, r[first], _pooled(net, projected, x, first))
    z = best @ net.out + net.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Net:
    """Adam on the logistic loss of the pooled responses. ``docs``: the words' table rows of each text."""
    rng = np.random.default_rng(seed)
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    net = {
        "table": rng.normal(0, 0.1, (TABLE, DIM)),
        "filters": rng.normal(0, 0.4, (len(_SLICES), DIM, FILTERS)),
        "shift": np.zeros(OUT),
        "out": np.full(OUT, 0.3) * np.tile([1, 1, 1, 1, -1, -1], len(WIDTHS)),
        "bias": np.array(np.log(share / (1 - share))),
    }
    done = lambda: Net(net["table"], net["filters"], net["shift"], net["out"], float(net["bias"]))
    if n < 2 or y.min() == y.max():
        net["out"][:] = 0
        return done()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    state = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in net.items()}
    table_step = np.zeros(TABLE)

    def update(name: str, grad: np.ndarray, rate: float, at=slice(None)) -> None:
        m, v = state[name]
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        net[name][at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-6)

    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 2)
        for rows in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            gz_all = {k: np.zeros_like(net[k]) for k in ("filters", "shift", "out")}
            gb, touched, grads = 0.0, [], []
            for i in rows:
                ids = docs[i]
                e = net["table"][ids].sum(1) if len(ids) else np.zeros((1, DIM))
                pooled, at = np.zeros(OUT), np.zeros(OUT, int)
                for k, width in enumerate(WIDTHS):
                    slices = [s for s, (w, _) in enumerate(_SLICES) if w == k]
                    response = e @ net["filters"][slices[0]]
                    for j in range(1, width):
                        response[: len(e) - j] += e[j:] @ net["filters"][slices[j]]
                    span = slice(k * FILTERS, (k + 1) * FILTERS)
                    at[span] = response.argmax(0)
                    pooled[span] = response.max(0)
                pooled += net["shift"]
                live = pooled > 0
                z = np.where(live, pooled, 0) @ net["out"] + float(net["bias"])
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(rows)
                gb += g
                gz_all["out"] += g * np.where(live, pooled, 0)
                down = g * net["out"] * live
                gz_all["shift"] += down
                if not len(ids):
                    continue
                for s, (k, j) in enumerate(_SLICES):
                    span = slice(k * FILTERS, (k + 1) * FILTERS)
                    place, d = at[span] + j, down[span]
                    inside = (place < len(e)) & (d != 0)
                    if inside.any():
                        place, d = place[inside], d[inside]
                        gz_all["filters"][s][:, inside] += e[place].T * d
                        for column in range(ids.shape[1]):
                            touched.append(ids[place, column])
                            grads.append((net["filters"][s][:, inside] * d).T)
            for k, grad in gz_all.items():
                update(k, grad, rate)
            update("bias", np.array(gb), rate, ())
            if touched:
                used, place = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(used), DIM))
                np.add.at(grad, place, np.concatenate(grads))
                table_step[used] += 1
                update("table", grad, rate, used)
    return done()


class Model(NamedTuple):
    net: Net
    thresholds: dict[str, float]
    shared: Broadcast  # the net; a model is sent to the tasks once, whatever is scored with it


def score_bins(scores_: np.ndarray) -> np.ndarray:
    """The bin of each score: ``BINS`` to a unit of log odds, one half at an edge."""
    return np.floor(np.log(scores_ / (1 - scores_)) * BINS).astype(np.int64)


def thresholds(langs: list[str], bins: np.ndarray, y: np.ndarray, n: np.ndarray, least: int = 20) -> dict[str, float]:
    """For each language with at least ``least`` rows of either label, the threshold with the fewest mistakes over the
    counts ``n`` of rows by language, bin and label, in the middle between neighbouring bins and as near to one half as
    possible."""
    out = {}
    of = np.array(langs, object)
    for lang in sorted(set(langs)):
        at = of == lang
        if min(n[at & (y == v)].sum() for v in (0, 1)) < least:
            continue
        found, place = np.unique(bins[at], return_inverse=True)
        ones, zeros = (np.bincount(place, np.where(y[at] == v, n[at], 0), minlength=len(found)) for v in (1, 0))
        wrong = np.r_[0, np.cumsum(ones)] + np.r_[np.cumsum(zeros[::-1])[::-1], 0]
        edges = np.r_[found[0] - 0.5, found + 0.5, found[-1] + 1.5]
        inside = (edges[:-1] < 0) & (0 < edges[1:])
        cuts = np.where(inside, 0.0, (edges[:-1] + edges[1:]) / 2)
        cuts = 1 / (1 + np.exp(-cuts / BINS))
        best = np.flatnonzero(wrong == wrong.min())
        out[lang] = float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])
    return out


def calibrated(scores_: np.ndarray, y: np.ndarray, langs: list[str | None], least: int = 20) -> dict[str, float]:
    """The thresholds over the rows given, each counted once."""
    known = np.array([x is not None for x in langs], bool)
    return thresholds([x for x in langs if x is not None], score_bins(scores_[known]), y[known], np.ones(known.sum(), np.int64), least)


def _collect_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        parts = list(word_ids(batch.column(0)))
        row = np.concatenate([r for r, _ in parts]) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([x for _, x in parts]) if parts else np.zeros((0, 3), np.int32)
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        yield pa.record_batch([pa.array([x.tobytes() for x in np.split(ids.astype(np.uint16), cuts[1:-1])] if batch.num_rows else [], pa.binary()), batch.column(1), batch.column(2).cast(pa.int32())], ["ids", "lang", "y"])


def _seen(net: Net, words: list[np.ndarray]) -> np.ndarray:
    projected = project(net)
    z = np.array([_pooled(net, projected, x, np.zeros(1, int))[0] @ net.out + net.bias if len(x) else net.bias for x in words])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the sample to the net, its arrays as bytes, and how many rows of a language and label are in each bin."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    rows.sort(key=lambda r: (r["y"], r["lang"] or "", r["ids"]))  # tasks give their rows in any order
    words = [np.frombuffer(r["ids"], np.uint16).reshape(-1, 3) for r in rows]
    y = np.array([r["y"] for r in rows], float)
    net = train(words, y)
    seen, half = np.full(len(y), 0.5), np.arange(len(y)) % 2
    for k in (0, 1):
        other = train([x for x, h in zip(words, half) if h != k], y[half != k])
        seen[half == k] = _seen(other, [x for x, h in zip(words, half) if h == k])
    counts = Counter((r["lang"], int(b), r["y"]) for r, b in zip(rows, score_bins(seen)) if r["lang"] is not None)
    del rows, words, seen, y
    arrays = [pa.array([x.tobytes()], pa.binary()) for x in net[:-1]]
    binned = [{"lang": lang, "bin": bin_, "y": y, "n": n} for (lang, bin_, y), n in counts.items()]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("bin", pa.int64()), ("y", pa.int32()), ("n", pa.int64())]))
    yield pa.record_batch([*arrays, pa.array([net.bias]), pa.array([binned], kind)], [*Net._fields, "counts"])
    give_back()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Train on at most ``bound`` labelled rows of either label for which ``learn`` holds, and calibrate on all of them;
    without rows, or with one label only, every text gets the same score. A task trains, so that the driver holds the net
    only and not the sample.

    No row is scored by a net that was trained on it: those of the sample by one that was trained on the other half of
    it, all others by the model's own.
    """
    known, sample = _labelled(labels, learn, label, bound)
    marked = docs.join(F.broadcast(sample), "doc_id").select("text", "lang", "_label")
    rows = marked.mapInArrow(_collect_ids, "ids binary, lang string, y int").repartition(1)
    kinds = "table binary, filters binary, shift binary, out binary, bias double"
    row = rows.mapInArrow(_trained, f"{kinds}, counts array<struct<lang: string, bin: bigint, y: int, n: bigint>>").first()
    counts: Counter = Counter()
    if row is None:  # a plan that is known to have no rows has no task either
        net = train([], np.zeros(0))
    else:
        shapes = (TABLE, DIM), (len(_SLICES), DIM, FILTERS), OUT, OUT
        net = Net(*(np.frombuffer(x).reshape(shape) for x, shape in zip(row, shapes)), row.bias)
        counts.update({(c.lang, c.bin, c.y): c.n for c in row.counts})
    model = Model(net, {}, docs.sparkSession.sparkContext.broadcast(tuple(net)))
    for r in _scored_bins(docs, learn, model, known, sample).collect():  # a few thousand rows a language
        counts[r.lang, r.bin, r.y] += r.n
    keys = list(counts)
    column = lambda i: np.array([k[i] for k in keys], np.int64)
    return model._replace(thresholds=thresholds([k[0] for k in keys], column(1), column(2), np.array([counts[k] for k in keys], np.int64)))


def _labelled(labels: DataFrame, learn: Column, label: str, bound: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, _label`` of all labelled ids for which ``learn`` holds, an id with both labels under each; and of the sample, at
    most ``bound`` ids of either label. Both are stored: what follows neither groups nor sorts the labels again."""
    of = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    known = stored(of.select("doc_id", F.col(label).alias("_label")).distinct(), "toxicity-labelled")
    first = [first_ids(known.where(F.col("_label") == v), bound) for v in (0, 1)]
    return known, stored(first[0].unionByName(first[1]).coalesce(1), "toxicity-sample")


def _counted(docs: DataFrame, labels: DataFrame, learn: Column, label: str, model: Model, bound: int) -> DataFrame:
    """``lang, bin, y, n`` of all labelled rows for which ``learn`` holds, but those of the sample."""
    return _scored_bins(docs, learn, model, *_labelled(labels, learn, label, bound))


def _scored_bins(docs: DataFrame, learn: Column, model: Model, known: DataFrame, sample: DataFrame) -> DataFrame:
    rest = known.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    usable = docs.where(F.col("lang").isNotNull() & learn)
    if known.count() <= MOST_BROADCAST:
        scored = score(usable.join(F.broadcast(rest), "doc_id"), model, ["lang", "_label"])
    else:  # scores are moved, not texts
        scored = score(usable, model, ["doc_id", "lang"]).join(rest, "doc_id")
    bin_ = F.floor(F.log(F.col("_score") / (1 - F.col("_score"))) * BINS)
    return scored.groupBy("lang", bin_.alias("bin"), F.col("_label").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``_score``, the probability of label 1. A null or empty text has no words and gets
    the lowest evidence there is; repeated rows get equal scores; no rows give no rows."""
    shared = model.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(*shared.value)
        projected = project(net)
        for batch in (part for whole in batches for part in slices(whole)):
            k = batch.num_columns - 1
            yield pa.record_batch([*batch.columns[:k], pa.array(scores(net, projected, batch.column(k)))], [*batch.schema.names[:k], "_score"])
        give_back()

    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, StructType([*kept.schema.fields, StructField("_score", DoubleType())]))


def threshold(model: Model, lang: Column) -> Column:
    """The calibrated threshold of a language; one half for one without, or none."""
    out = F.lit(0.5)
    for name, value in model.thresholds.items():
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out
