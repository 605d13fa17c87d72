"""Ranking candidate labels per document.

All labels of a document are scored, normalised and ranked inside its row, as arrays of one entry per label. Documents
never meet a label table in a join, and no step shuffles.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramlode.functions.text import clean_tokens
from gramlode.operators.sizing import fits_broadcast
from gramlode.session import stored

# A scorer adds nothing but one column: the array of raw scores, in the order of the labels.
Scorer = Callable[[DataFrame, list[str], str, list[str]], DataFrame]

# Bytes of text that a model is given at once.
BATCH_BYTES = 1 << 20


def _words(label: str) -> list[str]:
    spaced = "".join(c if "a" <= c <= "z" else " " for c in label.lower())
    return list(dict.fromkeys(spaced.split()))


def word_rate(docs: DataFrame, keep: list[str], text: str, labels: list[str]) -> DataFrame:
    """Occurrences of a label's words per 100 characters of text."""
    words = [_words(label) for label in labels]
    vocabulary = sorted({w for ws in words for w in ws})
    tokens = docs.select(*keep, clean_tokens(text).alias("_t"), F.length(text).alias("_len"))
    found = tokens.select(*keep, "_len", F.filter("_t", lambda t: t.isin(vocabulary)).alias("_hits"))

    def rate_of(label_words: list[str]) -> Column:
        n = F.size(F.filter("_hits", lambda t: t.isin(label_words)))
        return F.lit(100.0) * n / F.greatest("_len", F.lit(1))

    rate = F.array(*[rate_of(ws) for ws in words])
    return found.select(*keep, rate.alias("raw"))


# A model: one list of raw scores, in the order of the labels, per text.
Model = Callable[[list[str], list[str]], list[list[float]]]


@functools.lru_cache(maxsize=4)
def _loaded(load: Callable[..., Model], arguments: tuple) -> Model:
    """The model of a worker, which stays for its later tasks."""
    return load(*arguments)


def loaded_scorer(load: Callable[..., Model], *arguments, batch_bytes: int = BATCH_BYTES) -> Scorer:
    """A scorer from a model that is loaded once per worker: ``load(*arguments)`` gives ``score(texts, labels)``.

    ``load`` is a function of a module and ``arguments`` are hashable, such as the path of the model. The model is called
    with about ``batch_bytes`` of text at a time (one text may have more), whatever the length of the texts. Rows keep their
    columns; a null text is scored as an empty one. An answer of another length than the labels is an error.
    """

    def scorer(docs: DataFrame, keep: list[str], text: str, labels: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = None
            for batch in (part for whole in batches for part in _by_bytes(whole, batch_bytes)):
                score = score or _loaded(load, arguments)
                raw = score([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], labels)
                if any(len(scores) != len(labels) for scores in raw) or len(raw) != batch.num_rows:
                    raise ValueError(f"the model must give {len(labels)} scores for each of {batch.num_rows} texts")
                scores = pa.array(raw, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*batch.schema.names[:-1], "raw"])

        rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
        schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("raw", T.ArrayType(T.DoubleType()))])
        return rows.mapInArrow(run, schema)

    return scorer


def _by_bytes(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts, in the last column, take about ``size`` bytes."""
    begin = held = 0
    for i, text in enumerate(batch.column(batch.num_columns - 1)):
        held += len(text.as_buffer()) if text.is_valid else 0
        if held >= size:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _given(score: Model) -> Model:
    return score


def model_scorer(score: Model) -> Scorer:
    """A scorer from a function that needs no loading."""
    return loaded_scorer(_given, score)


def letter_rate(power: float) -> Model:
    """A model without a file, for trying the slot out: how often a label's first letter occurs in the text, in hundredths
    of its length, to a power."""

    def score(texts: list[str], labels: list[str]) -> list[list[float]]:
        rate = lambda t, label: 100.0 * t.lower().count(label[0].lower()) / max(len(t), 1)
        return [[rate(t, label) ** power for label in labels] for t in texts]

    return score


def label_scores(
    docs: DataFrame, labels: list[str], key: list[str], text: str, scorer: Scorer = word_rate
) -> DataFrame:
    """``(key…, label, score, rank)``: the best label has rank 1, equal scores rank in the order of the labels."""
    names = [label for label in labels if label.strip()]
    if not names:
        raise ValueError("no labels to score")
    raw = scorer(docs, key, text, names)
    # struct order ranks: higher score first, then the earlier label
    entries = F.transform("raw", lambda s, i: F.struct((-s).alias("s"), i.alias("pos")))
    ranked = raw.select(*key, F.array_sort(entries).alias("_r"))
    # softmax; the first entry has the largest score, which is taken off so that no exponential overflows
    low = F.get("_r", F.lit(0))["s"]
    total = F.aggregate("_r", F.lit(0.0), lambda total, x: total + F.exp(low - x["s"]))
    summed = ranked.select(*key, "_r", low.alias("_low"), total.alias("_sum"))
    rows = summed.select(*key, "_low", "_sum", F.posexplode_outer("_r").alias("_i", "_x")).where(F.col("_x").isNotNull())
    label = F.element_at(F.array(*[F.lit(name) for name in names]), F.col("_x.pos") + 1)
    share = F.exp(F.col("_low") - F.col("_x.s")) / F.col("_sum")
    return rows.select(*key, label.alias("label"), share.alias("score"), (F.col("_i") + 1).alias("rank"))


#: An inverted index of up to this many entries, of words and labels, is sent to the tasks.
INDEX_ENTRIES = 16_000_000


class _Index:
    """Words and labels as arrays. A label stands under its most frequent word in ``common``, under its others in ``rare``.

    A label that only its most frequent word leads to has that word's count; there are as many of these as the word has
    labels, less those met through a rare word. So a text looks at few labels of a frequent word, and all are counted.
    """

    def __init__(self, word: np.ndarray, pos: np.ndarray, words: int, labels: int) -> None:
        degree = np.bincount(word, minlength=words)
        order = np.lexsort((word, degree[word], pos))  # a label's most frequent word is its last
        word, pos = word[order].astype(np.int32), pos[order].astype(np.int32)
        last = np.r_[pos[1:] != pos[:-1], True] if len(pos) else np.zeros(0, bool)
        self.words, self.labels = words, labels
        self.common, self.rare = self._lists(word[last], pos[last]), self._lists(word[~last], pos[~last])
        self.top = np.zeros(labels, np.int32)
        self.top[pos[last]] = word[last]
        self.of_label = np.searchsorted(pos, np.arange(labels + 1)), word

    def _lists(self, word: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((pos, word))
        return np.searchsorted(word[order], np.arange(self.words + 1)), pos[order]


def _slices(lists: tuple[np.ndarray, np.ndarray], at: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the lists ``at``, and to which of them each belongs."""
    begin, entries = lists[0][at], lists[1]
    size = lists[0][at + 1] - begin
    size = size if most is None else np.minimum(size, most)
    owner = np.repeat(np.arange(len(at)), size)
    return entries[np.arange(len(owner)) - (np.cumsum(size) - size)[owner] + begin[owner]], owner


def _best(index: _Index, word: np.ndarray, n: np.ndarray, length: int, k: int, count: np.ndarray, seat: np.ndarray):
    """Positions and counts of a text's ``k`` best labels, the largest rate, and the sum that the softmax divides by.

    ``count`` (per word) and ``seat`` (per label) are zero and stay so between the texts.
    """
    count[word] = n
    # labels met through a rare word, each once, with their whole count
    label, owner = _slices(index.rare, word)
    seat[label] = np.arange(1, len(label) + 1)
    own = seat[label] == np.arange(1, len(label) + 1)
    met = label[own]
    number = np.cumsum(own) - 1
    met_n = np.bincount(number[seat[label] - 1], n[owner], minlength=len(met)).astype(np.int64) + count[index.top[met]]
    # labels that only their most frequent word leads to
    through = np.bincount(index.top[met], minlength=index.words)[word] if len(met) else np.zeros(len(word), np.int64)
    alone = index.common[0][word + 1] - index.common[0][word] - through
    order = np.argsort(-n, kind="stable")
    enough = np.searchsorted(np.cumsum(alone[order]), k)  # less frequent words give no better label
    first = order[n[order] >= n[order[min(enough, len(order) - 1)]]] if len(order) else order
    more, owner = _slices(index.common, word[first], k + through[first])
    unmet = seat[more] == 0
    pos, counts = np.r_[met, more[unmet]].astype(np.int64), np.r_[met_n, n[first][owner[unmet]]]
    ranked = np.lexsort((pos, -counts))[:k]
    pos, counts = pos[ranked], counts[ranked]
    hit = len(met) + int(alone.sum())
    if len(pos) < k:  # the first labels without a hit: a text with so few hits has them among its first
        near = np.arange(min(index.labels, hit + k))
        words, owner = _slices(index.of_label, near)
        free = near[np.bincount(owner, count[words], minlength=len(near)) == 0][: k - len(pos)]
        pos, counts = np.r_[pos, free], np.r_[counts, np.zeros(len(free), np.int64)]
    rate = 100.0 / max(length, 1)
    low = rate * counts[0] if len(counts) else 0.0
    whole = np.exp(rate * met_n - low).sum() + (alone * np.exp(rate * n - low)).sum() + (index.labels - hit) * np.exp(-low)
    count[word], seat[label] = 0, 0
    return pos, np.exp(rate * counts - low) / whole


def _score_best(shared, k: int):
    """Rows ``_doc, _len, _found`` to ``_doc, _best``: the text's best labels in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SimpleNamespace(**shared.value)
        count, seat = np.zeros(index.words, np.int64), np.zeros(index.labels, np.int64)
        for batch in batches:
            found = batch.column(2)
            cuts = np.asarray(found.offsets)
            word, n = (np.asarray(found.values.field(i)) for i in (0, 1))
            best = [
                _best(index, word[a:b], n[a:b], length or 1, k, count, seat)
                for a, b, length in zip(cuts[:-1], cuts[1:], batch.column(1).to_pylist())
            ]
            ends = np.r_[0, np.cumsum([len(pos) for pos, _ in best])]
            pos, score = (np.concatenate(x) if best else np.zeros(0) for x in (list(zip(*best)) or [(), ()]))
            entries = pa.StructArray.from_arrays([pa.array(pos, pa.int64()), pa.array(score, pa.float64())], ["pos", "score"])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["_doc", "_best"])

    return run


def top_labels(docs: DataFrame, labels: DataFrame, key: list[str], text: str, k: int = 10) -> DataFrame:
    """``(key…, label, score, rank)`` of the ``k`` best of very many labels, scored by word rate as in ``label_scores``.

    ``labels (pos, label)`` is a stored table with positions from 0. An inverted index leads from a word to its labels, so a text meets
    only labels that share a word with it; the others have rate zero, take part in the shares by their number, and fill
    the places that are left in the order of their positions. A text's words are counted first: one row per document
    and known word moves. With an index of at most ``INDEX_ENTRIES`` labels are met inside the document's row, and only labels
    with a rare word of it one by one. With a larger one, words and labels are joined.
    """
    spaced = F.array_remove(F.split(F.regexp_replace(F.lower("label"), "[^a-z]+", " "), " "), "")
    index = labels.select("pos", F.explode(F.array_distinct(spaced)).alias("_word"))
    index = stored(index, "label-index")
    total = labels.count()
    small = max(total, index.count()) <= INDEX_ENTRIES
    tokens = docs.select(*key, F.length(text).alias("_len"), clean_tokens(text).alias("_t"))
    rows = tokens.select(*key, "_len", F.explode_outer("_t").alias("_word"))
    words = stored(index.select("_word").distinct().orderBy("_word"), "label-words")
    known = words.withColumn("_known", F.lit(True))
    known = F.broadcast(known) if fits_broadcast(words) else known
    met = rows.join(known, "_word", "left").select(*key, "_len", F.when(F.col("_known"), F.col("_word")).alias("_word"))
    counts = met.groupBy(*key, "_len", "_word").agg(F.count(F.lit(1)).alias("n"))
    ranked = (_ranked_by_index if small else _ranked_by_join)(counts, index, words, total, key, k)
    names = F.broadcast(labels) if fits_broadcast(labels) else labels
    return ranked.join(names.select("pos", "label"), "pos").select(*key, "label", "score", "rank")


def _ranked_by_index(counts: DataFrame, index: DataFrame, words: DataFrame, total: int, key: list[str], k: int) -> DataFrame:
    """``(key…, pos, score, rank)`` from ``(key…, _len, _word, n)``, the index in every task."""
    spark = counts.sparkSession
    names = sorted(words.toArrow()["_word"].to_pylist())
    ids = spark.createDataFrame(pa.table({"_word": pa.array(names, pa.string()), "_id": pa.array(range(len(names)), pa.int64())}))
    entries = index.join(ids, "_word").select("_id", "pos").toArrow()
    word, pos = (np.asarray(entries[c].combine_chunks()) if len(entries) else np.zeros(0, np.int64) for c in ("_id", "pos"))
    shared = spark.sparkContext.broadcast(vars(_Index(word, pos, len(names), total)))  # plain arrays: workers need no module for them
    # numbers instead of words: the rows are one per document and known word by now
    numbered = counts.join(F.broadcast(ids) if fits_broadcast(words) else ids, "_word", "left")
    of = F.collect_list(F.when(F.col("_id").isNotNull(), F.struct(F.col("_id").alias("w"), "n")))
    found = numbered.groupBy(*key, "_len").agg(of.alias("_found"))
    doc = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(key))).alias("_doc")
    packed = found.select(doc, F.col("_len").cast("long"), "_found")
    schema = T.StructType([packed.schema["_doc"], T.StructField("_best", T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("score", T.DoubleType())])))])
    best = packed.mapInArrow(_score_best(shared, k), schema)
    each = best.select("_doc", F.posexplode("_best").alias("_i", "_x"))
    back = [F.col(f"_doc.k{i}").alias(c) for i, c in enumerate(key)]
    return each.select(*back, F.col("_x.pos").alias("pos"), F.col("_x.score").alias("score"), (F.col("_i") + 1).alias("rank"))


def _ranked_by_join(counts: DataFrame, index: DataFrame, words: DataFrame, total: int, key: list[str], k: int) -> DataFrame:
    """The same, words and labels joined: one row per document and label that was hit moves."""
    hits = counts.withColumnRenamed("n", "_n").join(index, "_word", "left")
    counted = hits.groupBy(*key, "_len", "pos").agg(F.sum("_n").alias("n"))
    hit = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct((-F.col("n")).alias("n"), "pos")))
    found = counted.groupBy(*key, "_len").agg(F.array_sort(hit).alias("_hit"))
    rate = lambda n: F.lit(100.0) * n / F.greatest("_len", F.lit(1))
    # places that are left go to the first labels without a hit: among the first 2 k positions there are enough, unless hit
    best = F.slice("_hit", 1, k)
    among = F.sequence(F.lit(0), F.least(F.lit(total - 1), F.size("_hit") + k - 1))
    free = F.slice(F.array_except(among, F.transform("_hit", lambda h: h["pos"].cast("int"))), 1, k)
    filled = F.slice(F.concat(best, F.transform(free, lambda p: F.struct(F.lit(0).cast("long").alias("n"), p.cast("long").alias("pos")))), 1, k)
    low = F.coalesce(rate(-F.get("_hit", F.lit(0))["n"]), F.lit(0.0))
    prepared = found.select(*key, "_len", "_hit", filled.alias("_best"), low.alias("_low"))
    others = (total - F.size("_hit")) * F.exp(-F.col("_low"))
    whole = F.aggregate("_hit", F.lit(0.0), lambda sum_, h: sum_ + F.exp(rate(-h["n"]) - F.col("_low"))) + others
    summed = prepared.select(*key, "_len", "_best", "_low", whole.alias("_sum"))
    each = summed.select(*key, "_len", "_low", "_sum", F.posexplode("_best").alias("_i", "_x"))
    share = F.exp(rate(-F.col("_x.n")) - F.col("_low")) / F.col("_sum")
    return each.select(*key, F.col("_x.pos").alias("pos"), share.alias("score"), (F.col("_i") + 1).alias("rank"))
