"""Scoring texts with a hierarchical Pitman-Yor language model.

Every word of the corpus has a restaurant: its dishes are the words that follow it, whatever their number. The parent of all
these is a model over ``SYMBOLS`` symbols: the most frequent words are symbols of their own, all others share one of
256 classes by their ending. It has one restaurant per context symbol, which share one parent, and the probability of a
word in its class is a restaurant again, one table per word, whose parent gives all to unknown words. Seatings are sampled
by Gibbs: in a sweep all customers are taken from their tables and seated anew, in the number of tables that follows from
the discount and the parent's probability of the dish; a table of a symbol's restaurant is a customer of the parent.
The predictive probabilities are averaged over the samples.

Counting runs where the texts are. Word counts of the whole corpus stay distributed; only the most frequent
words and the symbol table are sent to the tasks, both bounded. Any other word makes up less than a ``HEAD``-th of the
words, so that joining its occurrences with its count has no hot key. Pairs of neighbouring words are dealt by the first
word to buckets of about ``DEALT`` tokens, those of a very frequent first word by both words; a bucket seats its
restaurants, scores its pairs and returns sums per document. Between tasks go packed columns of some bytes a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import byte_slices, give_back
from gramlode.llm.tokens import Block, blocks, mixed, word_hashes
from gramlode.session import stored

SYMBOLS, CLASSES = 2048, 256
_OWN = SYMBOLS - CLASSES
#: Most words whose counts are sent to every task.
HEAD = 1 << 18
#: Rounds of seating all contexts and then the parent; sweeps over all customers before and while samples are kept.
ROUNDS, BURN_IN, KEPT = 2, 4, 3
CONCENTRATION = 5.0
#: Customers and tables up to which the ways to sit are counted out.
MOST_KNOWN = 4096, 256
#: The token that ends a text, and the context of its first word.
END = 0x5EED_0000_0000_0001
_MERGE = 4 << 20
#: Tokens of a bucket, and bytes of text whose pairs are dealt together.
DEALT, CHUNK = 3 << 19, 4 << 20
#: Marks the code of a word that is not among the frequent ones: its hash, with the class in the last byte.
_TAIL, _HASH = 1 << 63, 0x7FFFFFFFFFFFFF00


def _endings(block: Block) -> np.ndarray:
    """Class of each word by its last two bytes."""
    last = block.data[block.end - 1].astype(np.int64)
    before = np.where(block.end - block.begin > 1, block.data[np.maximum(block.end - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 131) % CLASSES


def sequences(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, hash and class of every token, the end of each text included, and whether it begins a text. A text above the
    block size comes in pieces; only the first of them begins it."""
    before = -1
    for block in blocks(column):
        h, cls = word_hashes(block), _endings(block)
        h[h == np.uint64(END)] += np.uint64(1)
        piece = block.piece
        ends = np.flatnonzero(block.last)
        at = np.searchsorted(piece, ends, side="right")
        h, cls, piece = np.insert(h, at, np.uint64(END)), np.insert(cls, at, 0), np.insert(piece, at, ends)
        rows = block.rows[piece]
        if len(rows):
            yield rows, h, cls, np.r_[rows[0] != before, rows[1:] != rows[:-1]]
            before = rows[-1]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``text`` to ``h, cls, n``: one row per word of a partition, as far as memory lets them be merged."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, cls, n = (np.concatenate(x) for x in zip(*held))
        words, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return words, cls[first], np.bincount(inverse, n).astype(np.int64)

    def out(x: tuple) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["h", "cls", "n"])

    for batch in batches:
        for _, h, cls, _ in sequences(batch.column(0)):
            words, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((words, cls[first], n))
            size += len(words)
            if size > _MERGE:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > _MERGE // 2:
                    yield out(held.pop())
                    size = 0
    if held:
        yield out(merged())


class Vocabulary:
    """The frequent words, and what the others of each class come to."""

    def __init__(self, counts: DataFrame) -> None:
        self.counts = counts
        self.total, self.size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        # the smallest count that few enough words reach, from a histogram of a few hundred rows
        size = F.floor(F.log2("n") * 8).cast("int")
        histogram = sorted(((r.b, r.w) for r in counts.groupBy(size.alias("b")).agg(F.count(F.lit(1)).alias("w")).collect()), reverse=True)
        least, words = None, 0
        for bin_, n in histogram:
            words += n
            if words > HEAD:
                break
            least = bin_
        head = counts.where(size >= (least if least is not None else 1 << 30)).select("h", "cls", "n").toArrow()
        h, cls, n = (np.asarray(head[c].combine_chunks()) if len(head) else np.zeros(0, np.int64) for c in ("h", "cls", "n"))
        order = np.argsort(h.view(np.uint64))
        self.h, self.cls, self.n = h.view(np.uint64)[order], cls[order].astype(np.int64), n[order]
        # symbols: 0 ends a text, then the most frequent words, then the classes
        ranked = np.lexsort((self.h, -self.n))
        ranked = ranked[self.h[ranked] != np.uint64(END)][: _OWN - 1]
        self.symbol = _OWN + self.cls
        self.symbol[ranked] = 1 + np.arange(len(ranked))
        self.symbol[self.h == np.uint64(END)] = 0
        own = self.symbol < _OWN
        stats = counts.where(F.col("h") != END).groupBy("cls").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("w"), F.sum((F.col("n") == 1).cast("long")).alias("one"), F.sum((F.col("n") == 2).cast("long")).alias("two")
        )
        words_of, n_of, few = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(2)
        for r in stats.collect():
            words_of[r.cls], n_of[r.cls] = r.w, r.n
            few += [r.one, r.two]
        taken = own & (self.h != np.uint64(END))
        np.subtract.at(words_of, self.cls[taken], 1)
        np.subtract.at(n_of, self.cls[taken], self.n[taken])
        few -= [(self.n[taken] == 1).sum(), (self.n[taken] == 2).sum()]
        self.discount = discount(*few)
        self.words_of, self.n_of = words_of, n_of

    def in_class(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class, ``c`` its count."""
        n = np.maximum(self.n_of[cls], 1)
        known, unknown = np.maximum(c - self.discount, 1e-12) / n, self.discount * self.words_of[cls] / n
        return np.where(self.n_of[cls] > 0, np.log10(np.maximum(np.where(c > 0, known, unknown), 1e-300)), 0.0)

    def shared(self) -> tuple:
        return self.h, self.n, self.symbol


def discount(one: float, two: float) -> float:
    """The discount that fits how many words were seen once and twice."""
    return min(max(one / max(one + 2 * two, 1), 0.05), 0.95)


def _symbols(shared: tuple, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and count of tokens; count -1 for words that are not among the frequent ones."""
    words, n, symbol = shared
    if not len(words):
        return np.where(h == np.uint64(END), 0, _OWN + cls), np.full(len(h), -1)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = words[at] == h
    return np.where(hit, symbol[at], np.where(h == np.uint64(END), 0, _OWN + cls)), np.where(hit, n[at], -1)


def _contexts(symbol: np.ndarray, begins: np.ndarray, last: int = 0, end: int = 0) -> np.ndarray:
    """What stands before each token: ``last`` before the first if it does not begin a text, ``end`` before a text."""
    before = np.empty_like(symbol)
    before[0], before[1:] = last, symbol[:-1]
    before[begins] = end
    return before


def _count_pairs(shared):
    """Rows ``text`` to ``context, symbol, n`` of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            last = 0
            for _, h, cls, begins in sequences(batch.column(0)):
                symbol, _ = _symbols(shared.value, h, cls)
                pairs, n = np.unique(_contexts(symbol, begins, last) * SYMBOLS + symbol, return_counts=True)
                counts[pairs] += n
                last = symbol[-1]
        pairs = np.flatnonzero(counts)
        for a in range(0, len(pairs), 1 << 18):
            p = pairs[a : a + (1 << 18)]
            yield pa.record_batch([pa.array((p // SYMBOLS).astype(np.int32)), pa.array((p % SYMBOLS).astype(np.int32)), pa.array(counts[p])], ["context", "symbol", "n"])

    return run


class _Kept(dict):
    """What a process has worked out; it goes empty to the tasks."""

    def __reduce__(self) -> tuple:
        return _Kept, ()


_kept = _Kept()


def _arrangements(d: float) -> np.ndarray:
    """log of the weight of all ways in which n customers sit at t tables, by n and t (generalised Stirling numbers)."""
    if (d, MOST_KNOWN) in _kept:
        return _kept[d, MOST_KNOWN]
    _kept.clear()
    out = np.full((MOST_KNOWN[0] + 1, MOST_KNOWN[1] + 1), -np.inf)
    out[0, 0], t = 0.0, np.arange(MOST_KNOWN[1] + 1)
    for n in range(MOST_KNOWN[0]):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t[: n + 1] > 0, np.log(np.maximum(n - d * t[: n + 1], 1e-300)), -np.inf) if n < len(t) else np.log(n - d * t)
            out[n + 1, : len(stay)] = out[n, : len(stay)] + stay
        out[n + 1, 1:] = np.logaddexp(out[n + 1, 1:], out[n, :-1])
    _kept[d, MOST_KNOWN] = out
    return out


def seated(n: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """A draw of the tables of dishes with ``n`` customers each, in proportion to ``x ** t`` times the weight of all ways to
    sit at t tables. Beyond the known weights, by the law they tend to: tables besides the largest are a Poisson number."""
    out = np.ones(len(n))
    x = np.maximum(x, 1e-300)
    width = np.minimum(n, 16 + 6 * x / d)
    many = n > 1
    known = many & (n <= MOST_KNOWN[0]) & (width <= MOST_KNOWN[1])
    logs = _arrangements(d)
    for low, high in ((0, 4), (4, 24), (24, MOST_KNOWN[1])):
        at = np.flatnonzero(known & (width > low) & (width <= high))
        for i in range(0, len(at), 1 << 15):
            some = at[i : i + (1 << 15)]
            weight = logs[n[some].astype(np.int64), 1 : high + 1] + np.arange(1, high + 1) * np.log(x[some])[:, None]
            sums = np.cumsum(np.exp(weight - weight.max(axis=1)[:, None]), axis=1)
            out[some] = 1 + (sums < (rng.random(len(some)) * sums[:, -1])[:, None]).sum(axis=1)
    rest = np.flatnonzero(many & ~known)
    if len(rest):
        # customers at tables of the sizes that a tilt of their law by 1 - e**-y gives come to n
        low, high = np.zeros(len(rest)), np.full(len(rest), 60.0)
        for _ in range(50):
            y = (low + high) / 2
            less = np.log(x[rest]) + np.log(-np.expm1(-y)) + (1 - d) * y < np.log(n[rest])
            low, high = np.where(less, y, low), np.where(less, high, y)
        out[rest] = np.minimum(n[rest], 1 + rng.poisson(x[rest] * -np.expm1(-d * low) / d))
    return out


class Restaurant:
    """Dishes with ``n`` customers each, and Gibbs sampling of how many tables they sit at. All dishes move side by side.
    The probabilities depend on the numbers of tables alone; ``dish`` and ``size`` spell out one seating that has them."""

    def __init__(self, n: np.ndarray, parent: np.ndarray, d: float, rng: np.random.Generator) -> None:
        self.n, self.parent, self.d, self.rng = n, parent, d, rng
        self.held = np.ones(len(n))  # one table per dish to begin with

    def tables(self) -> np.ndarray:
        return self.held.astype(np.int64)

    @property
    def dish(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.tables())

    @property
    def size(self) -> np.ndarray:
        size = np.ones(int(self.held.sum()))
        size[np.cumsum(self.tables()) - self.tables()] += self.n - self.held
        return size

    def step(self) -> None:
        """Take all customers from their tables and seat them again. Given a gamma variable of the number of all tables, the
        dishes do not depend on each other."""
        among = self.rng.gamma(CONCENTRATION / self.d + self.held.sum())
        self.held = seated(self.n, self.d * among * self.parent, self.d, self.rng)

    def averaged(self) -> np.ndarray:
        """Tables per dish, averaged over the kept samples."""
        for _ in range(BURN_IN):
            self.step()
        total = np.zeros(len(self.n))
        for _ in range(KEPT):
            self.step()
            total += self.held
        return total / KEPT


def _seat(root: np.ndarray, d: float, seed: int):
    """The rows of one context to its tables per dish and the averaged predictive probabilities of its dishes."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        symbol, n = np.asarray(rows["symbol"].combine_chunks()), np.asarray(rows["n"].combine_chunks()).astype(float)
        order = np.argsort(symbol)
        symbol, n = symbol[order], n[order]
        context = key[0].as_py()
        tables = Restaurant(n, root[symbol], d, np.random.default_rng([seed, context])).averaged()
        back = (CONCENTRATION + d * tables.sum()) / (CONCENTRATION + n.sum())
        p = np.maximum(n - d * tables, 0) / (CONCENTRATION + n.sum()) + back * root[symbol]
        lists = lambda x, t: pa.array([x], pa.list_(t))
        return pa.table({"context": pa.array([context], pa.int32()), "back": pa.array([back], pa.float64()), "symbols": lists(symbol, pa.int32()), "tables": lists(tables, pa.float64()), "p": lists(p, pa.float64())})

    return run


def symbol_table(pairs: DataFrame) -> np.ndarray:
    """log10 of the probability of every symbol after every context, from ``context, symbol, n``: at most the square of
    ``SYMBOLS`` rows, a context's rows in one task."""
    one, two = pairs.agg(F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("n") == 2).cast("long")), F.lit(0))).first()
    d = discount(one, two)
    met = {r.symbol: r.n for r in pairs.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).collect()}
    customers = np.zeros(SYMBOLS)
    customers[list(met)] = list(met.values())
    uniform = np.full(SYMBOLS, 1 / SYMBOLS)
    kinds = "context int, back double, symbols array<int>, tables array<double>, p array<double>"
    served = None
    for round_ in range(ROUNDS):
        dishes = np.flatnonzero(customers)
        root = uniform.copy()
        if len(dishes):
            n = np.maximum(np.rint(customers[dishes]), 1)
            own = discount((n == 1).sum(), (n == 2).sum())
            tables = Restaurant(n, uniform[dishes], own, np.random.default_rng([round_])).averaged()
            root *= (CONCENTRATION + own * tables.sum()) / (CONCENTRATION + n.sum())
            root[dishes] += np.maximum(n - own * tables, 0) / (CONCENTRATION + n.sum())
        served = stored(pairs.groupBy("context").applyInArrow(_seat(root, d, round_), kinds), "lm-seated")
        each = F.explode(F.arrays_zip("symbols", "tables")).alias("x")
        sums = served.select(each).groupBy("x.symbols").agg(F.sum("x.tables").alias("n")).collect()
        customers[:] = 0
        for r in sums:
            customers[r.symbols] = r.n
    out = np.tile(root, (SYMBOLS, 1))
    for r in served.toLocalIterator():
        out[r.context] *= r.back
        out[r.context, r.symbols] = r.p
    return np.log10(out).astype(np.float32)


#: Kinds of rows between tasks: pairs of words, counts that a bucket asked for, texts, sums of pairs, sums of rare words.
PAIRS, COUNTS, TEXTS, SCORES, RARE = range(5)
ROW = "bucket int, chunk long, kind int, data binary, code long"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length in a few bytes a row: equal bytes of neighbouring rows stand together, and are compressed."""
    planes = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in columns)
    return np.int64(len(columns[0])).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    rows, kinds = int(np.frombuffer(data, np.int64, 1)[0]), [np.dtype(k) for k in kinds]
    planes = pa.decompress(data[8:], rows * sum(k.itemsize for k in kinds), "zstd", asbytes=True)
    out, at = [], 0
    for k in kinds:
        plane = np.frombuffer(planes, np.uint8, rows * k.itemsize, at).reshape(k.itemsize, rows)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(k))
        at += rows * k.itemsize
    return out


def _numbered(codes: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order and the place of each among them; the ``frequent`` ones need no sorting."""
    rare = codes >= np.uint64(_TAIL)
    often = codes[~rare].astype(np.int64)
    met = np.zeros(frequent, bool)
    met[often] = True
    others, at = np.unique(codes[rare], return_inverse=True)
    places = np.empty(len(codes), np.int64)
    places[~rare] = (np.cumsum(met) - 1)[often]
    places[rare] = at + int(met.sum())
    return np.r_[np.flatnonzero(met).astype(np.uint64), others], places


class Plan(NamedTuple):
    """How pairs are dealt: by their first word to ``common`` buckets, those of the first words marked in ``split`` by both
    words to ``apart`` more."""

    common: int
    apart: int
    split: np.ndarray

    def bucket(self, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        first = mixed(c)
        out = (first % np.uint64(self.common)).astype(np.int64)
        if self.apart:
            to = self.splits(c)
            out[to] = self.common + (mixed(first[to] * np.uint64(0x9E3779B97F4A7C15) + w[to]) % np.uint64(self.apart)).astype(np.int64)
        return out

    def splits(self, c: np.ndarray) -> np.ndarray:
        known = c < np.uint64(len(self.split))
        known[known] = self.split[c[known].astype(np.int64)]
        return known


def _plan(vocabulary: Vocabulary) -> Plan:
    split = vocabulary.n > DEALT // 4
    often = int(vocabulary.n[split].sum())
    return Plan(max(1, -(-(int(vocabulary.total) - often) // DEALT)), -(-often // DEALT), split)


def _codes(words: np.ndarray, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The place of a frequent word, or else its marked hash with its class."""
    tail = (h & np.uint64(_HASH)) | cls.astype(np.uint64) | np.uint64(_TAIL)
    if not len(words):
        return tail
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at.astype(np.uint64), tail)


def _code_column(h: str, cls: str) -> Column:
    return F.col(h).bitwiseAND(F.lit(_HASH)).bitwiseOR(F.col(cls).cast("long")).bitwiseOR(F.lit(-_TAIL))


def _chunks(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``…, text`` in parts, each with row, code and context's code of its tokens."""
    end = _codes(words, np.array([END], np.uint64), np.zeros(1, np.int64))[0]
    for batch in batches:
        for part in byte_slices(batch, batch.num_columns - 1, CHUNK):
            rows, codes, contexts, last = [], [], [], end
            for row, h, cls, begins in sequences(part.column(part.num_columns - 1)):
                w = _codes(words, h, cls)
                rows.append(row)
                codes.append(w)
                contexts.append(_contexts(w, begins, last, end))
                last = w[-1]
            yield part, np.concatenate(rows), np.concatenate(codes), np.concatenate(contexts)
    give_back()


def _row(bucket: int, chunk: int, kind: int, data: bytes) -> pa.RecordBatch:
    lists = [pa.array([x], t) for x, t in ((bucket, pa.int32()), (chunk, pa.int64()), (kind, pa.int32()), (data, pa.binary()), (None, pa.int64()))]
    return pa.record_batch(lists, NAMES)


def _pairs(chunk: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket with its part of the columns."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, columns = bucket[order], [x[order] for x in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield _row(int(bucket[a]), chunk, PAIRS, _packed(*(x[a:b] for x in columns)))


def _ahead(shared, plan: Plan):
    """Rows ``held_out, rid, text`` to what is wanted before the pairs are dealt: the words that are not among the frequent
    ones with the buckets that meet them, and the pairs whose first words stand in several buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, doc, w, c in _chunks(batches, shared.value[0]):
            chunk, held = part.column(1)[0].as_py(), np.asarray(part.column(0)).astype(bool)
            rare = w >= np.uint64(_TAIL)
            bucket, code = plan.bucket(c[rare], w[rare]), w[rare]
            order = np.lexsort((code, bucket))
            bucket, code = bucket[order], code[order]
            new = np.ones(len(code), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])
            rows, none = int(new.sum()), lambda kind: pa.nulls(int(new.sum()), kind)
            kind = pa.array(np.full(rows, COUNTS, np.int32))
            yield pa.record_batch([pa.array(bucket[new].astype(np.int32)), none(pa.int64()), kind, none(pa.binary()), pa.array(code[new].view(np.int64))], NAMES)
            if plan.apart:
                to = np.flatnonzero(plan.splits(c))
                yield from _pairs(chunk, plan.bucket(c[to], w[to]), c[to], w[to], (doc[to] * 2 + ~held[doc[to]]).astype(np.uint32))

    return run


def _deal(shared, plan: Plan, total: int, size: int):
    """Rows ``key, held_out, rid, text`` to the pairs of each bucket, and what is known of each text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, _ = shared.value
        known = np.log10((n + 1) / (total + size + 1))
        for part, doc, w, c in _chunks(batches, words):
            chunk, rows, key = part.column(2)[0].as_py(), part.num_rows, part.column(0)
            held = np.asarray(part.column(1)).astype(bool)
            often = w < np.uint64(_TAIL)
            base = np.bincount(doc[often], known[w[often].astype(np.int64)], rows)
            texts = _packed(
                np.asarray(key.fill_null(0)), np.asarray(key.is_valid()).astype(np.uint8), held.astype(np.uint8),
                np.bincount(doc, minlength=rows), np.bincount(doc[often], minlength=rows), base.astype(float),
            )
            yield _row(int(mixed(np.array([chunk], np.uint64))[0] % np.uint64(plan.common)), chunk, TEXTS, texts)
            yield from _pairs(chunk, plan.bucket(c, w), c, w, (doc * 2 + ~held[doc]).astype(np.uint32))

    return run


class Bucket:
    """The pairs of a bucket, and the restaurants of their first words."""

    def __init__(self, rows: pa.Table, bucket: int, plan: Plan, head: tuple, logs: np.ndarray, in_class) -> None:
        words, n_head, symbol = head
        kind = np.asarray(rows["kind"].combine_chunks())
        given = rows.filter(pa.array(kind == PAIRS))
        self.chunks = given["chunk"].to_pylist()
        parts = [_unpacked(x, np.uint64, np.uint64, np.uint32) for x in given["data"].to_pylist()]
        self.ends = np.cumsum([len(x[0]) for x in parts], dtype=np.int64)
        c, w, self.mark = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint32))
        contexts, ci = _numbered(c, len(words))
        self.words, self.word = _numbered(w, len(words))
        pairs, self.pair = np.unique(ci * max(len(self.words), 1) + self.word, return_inverse=True)
        self.c, self.w = np.divmod(pairs, max(len(self.words), 1))
        self.n = np.bincount(self.pair, self.mark & 1, len(pairs))
        # counts of words, and their probability after the context's symbol
        counts = rows.filter(pa.array(kind == COUNTS))
        code, n = (np.asarray(counts[x].combine_chunks()) if len(counts) else np.zeros(0, np.int64) for x in ("code", "n"))
        order = np.argsort(code.view(np.uint64), kind="stable")
        code, n = code.view(np.uint64)[order], n[order]
        end = _codes(words, np.array([END], np.uint64), np.zeros(1, np.int64))[0]
        often = self.words < np.uint64(_TAIL)
        place = np.where(often, self.words, np.uint64(0)).astype(np.int64)
        self.rare = ~often
        asked = np.zeros(len(self.words), np.int64)
        if len(code):
            at = np.minimum(np.searchsorted(code, self.words), len(code) - 1)
            asked = np.where(code[at] == self.words, n[at], 0)
        self.count = np.where(often, n_head[place], asked) if len(words) else asked

        def symbols(codes: np.ndarray) -> np.ndarray:
            rare = np.where(codes == end, 0, _OWN + (codes & np.uint64(0xFF)).astype(np.int64))
            frequent = codes < np.uint64(_TAIL)
            return np.where(frequent, symbol[np.where(frequent, codes, np.uint64(0)).astype(np.int64)], rare) if len(words) else rare

        of = symbols(self.words)
        leaf = np.where(of >= _OWN, in_class(self.count, np.maximum(of - _OWN, 0)), 0.0)
        self.parent = logs[symbols(contexts)[self.c], of[self.w]].astype(float) + leaf[self.w]
        self.contexts, self.customers = contexts, np.bincount(self.c, self.n, len(contexts))
        self.split = bucket >= plan.common
        if self.split:
            here = self.customers
            self.customers = n_head[contexts.astype(np.int64)].astype(float)
            self.scale = self.customers / np.maximum(here, 1)
        self.d = discount((self.n == 1).sum(), (self.n == 2).sum())
        self.rng = np.random.default_rng([bucket, 1])

    def tables(self, beside: np.ndarray | None = None) -> np.ndarray:
        """Tables per pair, averaged over the kept samples. A context that stands in several buckets has ``beside`` tables in
        the others; as long as these are not known, as many for each customer as here."""
        dish = np.flatnonzero(self.n)
        c, n, p = self.c[dish], self.n[dish], 10.0 ** self.parent[dish]
        t, total = np.ones(len(n)), np.zeros(len(n))
        for sweep in range(BURN_IN + KEPT):
            all_ = np.bincount(c, t, len(self.contexts))
            if self.split:
                all_ = all_ * self.scale if beside is None else all_ + beside
            among = self.rng.gamma(CONCENTRATION / self.d + all_)
            t = seated(n, self.d * among[c] * p, self.d, self.rng)
            total += t * (sweep >= BURN_IN)
        out = np.zeros(len(self.n))
        out[dish] = total / KEPT
        return out

    def of_contexts(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.c, tables, len(self.contexts))

    def logs(self, apart: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 of the predictive probability of every pair; ``apart``: the contexts of several buckets and their tables."""
        tables = self.tables()
        all_ = self.of_contexts(tables)
        if self.split:
            beside = np.maximum(apart[1][np.searchsorted(apart[0], self.contexts)] - all_, 0)
            tables = self.tables(beside)
            all_ = self.of_contexts(tables) + beside
        of = CONCENTRATION + self.customers
        own, back = np.maximum(self.n - self.d * tables, 0) / of[self.c], ((CONCENTRATION + self.d * all_) / of)[self.c]
        return np.where(own > 0, np.log10(np.maximum(own + back * 10.0**self.parent, 1e-300)), np.log10(back) + self.parent)


def _tables(plan: Plan, shared, table, in_class):
    """Rows of a bucket to the tables that each of its contexts has there."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = Bucket(rows, key[0].as_py(), plan, shared.value, table.value, in_class)
        out = pa.table({"context": pa.array(bucket.contexts.view(np.int64)), "tables": pa.array(bucket.of_contexts(bucket.tables()))})
        give_back()
        return out

    return run


def _score(plan: Plan, shared, table, in_class, apart, total: int, size: int):
    """Rows of a bucket to sums of its pairs by text, and its texts."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = Bucket(rows, key[0].as_py(), plan, shared.value, table.value, in_class)
        texts = rows.filter(pa.array(np.asarray(rows["kind"].combine_chunks()) == TEXTS)).select(["chunk", "kind", "data"]).to_pylist()
        out = [(x["chunk"], x["kind"], x["data"]) for x in texts]
        score, base = bucket.logs(apart.value), np.log10((bucket.count + 1) / (total + size + 1))
        for chunk, a, b in zip(bucket.chunks, [0, *bucket.ends[:-1]], bucket.ends):
            doc, word = (bucket.mark[a:b] >> 1).astype(np.int64), bucket.word[a:b]
            met = np.flatnonzero(np.bincount(doc))
            out.append((chunk, SCORES, _packed(met.astype(np.uint32), np.bincount(doc, score[bucket.pair[a:b]])[met])))
            rare = bucket.rare[word]
            if rare.any():
                doc, word = doc[rare], word[rare]
                met = np.flatnonzero(np.bincount(doc))
                seen = np.bincount(doc, bucket.count[word] > 0)[met].astype(np.uint32)
                out.append((chunk, RARE, _packed(met.astype(np.uint32), np.bincount(doc, base[word])[met], seen)))
        give_back()
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["chunk", "kind", "data"])

    return run


def _sums(key: tuple, rows: pa.Table) -> pa.Table:
    """What the buckets found for the texts of a part, put together."""
    kinds, data = rows["kind"].to_pylist(), rows["data"].to_pylist()
    id_, valid, held, tokens, known, base = _unpacked(data[kinds.index(TEXTS)], np.int64, np.uint8, np.uint8, np.int64, np.int64, float)
    score = np.zeros(len(id_))
    for kind, x in sorted(zip(kinds, data)):
        if kind == SCORES:
            doc, sums = _unpacked(x, np.uint32, float)
            score[doc] += sums
        elif kind == RARE:
            doc, sums, seen = _unpacked(x, np.uint32, float, np.uint32)
            base[doc] += sums
            known[doc] += seen
    columns = [pa.array(id_, mask=valid == 0), pa.array(held.astype(bool)), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)]
    return pa.table(columns, [x.split()[0] for x in TEXT.split(", ")])


TEXT = "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``, learning from the
    rows for which ``held_out`` is false.

    ``base_score`` is the add-one unigram model, ``score`` the model's log10 probability of the text, its end included.
    A null text is empty: its end alone is scored. Without any training row every symbol is equally likely and every
    word of a class certain. Rows with equal or null keys are scored each for itself.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"), held_out.alias("held_out"), F.monotonically_increasing_id().alias("rid"), F.col(f"`{text}`").cast("string").alias("text")
    )
    learned = rows.where(~F.col("held_out")).select("text")
    counts = learned.mapInArrow(_count_words, "h long, cls int, n long").groupBy("h").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))
    vocabulary = Vocabulary(stored(counts, "lm-words"))
    shared = spark.sparkContext.broadcast(vocabulary.shared())
    pairs = learned.mapInArrow(_count_pairs(shared), "context int, symbol int, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    table = spark.sparkContext.broadcast(symbol_table(stored(pairs, "lm-pairs")))
    n, v = int(vocabulary.total), int(vocabulary.size)
    leaf, plan = _leaf(vocabulary.n_of, vocabulary.words_of, vocabulary.discount), _plan(vocabulary)
    ahead = stored(rows.select("held_out", "rid", "text").mapInArrow(_ahead(shared, plan), ROW), "lm-ahead")
    known = vocabulary.counts.select(_code_column("h", "cls").alias("code"), "n")
    found = stored(ahead.where(F.col("kind") == COUNTS).join(known, "code").select("bucket", "kind", "code", "n"), "lm-asked")

    def dealt(given: DataFrame, counts: DataFrame):
        both = given.unionByName(counts, allowMissingColumns=True)
        return both.repartition(plan.common + plan.apart, "bucket").groupBy("bucket")

    apart = []
    if plan.apart:
        parts = dealt(ahead.where(F.col("kind") == PAIRS), found.where(F.col("bucket") >= plan.common))
        parts = parts.applyInArrow(_tables(plan, shared, table, leaf), "context long, tables double")
        apart = parts.groupBy("context").agg(F.sum("tables").alias("tables")).orderBy("context").collect()
    apart = spark.sparkContext.broadcast((np.array([r.context for r in apart], np.uint64), np.array([r.tables for r in apart], float)))
    scored = dealt(rows.mapInArrow(_deal(shared, plan, n, v), ROW), found).applyInArrow(_score(plan, shared, table, leaf, apart, n, v), "chunk long, kind int, data binary")
    sums = scored.groupBy("chunk").applyInArrow(_sums, TEXT)
    return sums.select("key", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _leaf(n_of: np.ndarray, words_of: np.ndarray, d: float):
    """``Vocabulary.in_class`` without the vocabulary's tables."""
    held = object.__new__(Vocabulary)
    held.n_of, held.words_of, held.discount = n_of, words_of, d
    return held.in_class


def perplexity(scored: DataFrame) -> DataFrame:
    """Per fold: ``held_out, texts, tokens, perplexity, base_perplexity``."""
    per = lambda name: F.pow(F.lit(10.0), -F.sum(name) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity")
    )

