"""Invertible Bloom lookup sketches of the paragraphs of a text.

A paragraph is a line, cut further at sentence ends and, where there are none, every 64 words. Its digest (64 bits, of
its words and of how often it occurred before) is added to three cells of a sketch: a count, the sum of the digests and
the sum of their check values. Sketches of two versions subtract cell by cell, common paragraphs cancel, and peeling
cells that hold a single digest recovers the paragraphs that differ. When peeling gets stuck, a sketch of twice the
size with other hashes is tried.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.llm.tokens import mixed

HASHES = 3
#: Cells of the sketch that is kept as a text's fingerprint.
CELLS = 24
ROWS_A_BUCKET, MOST_BUCKETS = 4096, 2000
_PARAGRAPH = re.compile(r"[^\n.!?]+(?:[.!?]+|\n|\Z)|[.!?]+")
_LONG, _WORDS, _WIDE = 800, 64, 2000


def paragraphs(text: str) -> list[str]:
    """Pieces of a text in order; pieces that hold nothing but white space are left out."""
    out = []
    for piece in _PARAGRAPH.findall(text):
        piece = piece.strip()
        if len(piece) <= _LONG:
            if piece:
                out.append(piece)
            continue
        words = piece.split()
        for i in range(0, len(words), _WORDS):
            part = " ".join(words[i : i + _WORDS])
            out.extend(part[j : j + _WIDE] for j in range(0, len(part), _WIDE))
    return out


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs; the second, third ... copy of a paragraph has a digest of its own."""
    digest = xxhash.xxh64_intdigest
    raw = np.fromiter((digest(p.encode("utf-8", "replace")) for p in paragraphs(text)), np.uint64)
    if len(raw) < 2:
        return mixed(raw)
    raw.sort()
    first = np.flatnonzero(np.r_[True, raw[1:] != raw[:-1]])
    copy = np.arange(len(raw)) - np.repeat(first, np.diff(np.r_[first, len(raw)]))
    return mixed(raw + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _check(keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ np.uint64(0xE7037ED1A0B428DB))


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All digests of several texts, and the text of each."""
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


class Sketches:
    """Sketches of several texts side by side, ``thirds`` times three cells each: counts, digest sums, check sums."""

    def __init__(self, thirds: np.ndarray, seed: int = 0) -> None:
        self.thirds, self.seed = thirds, seed
        self.starts = HASHES * (np.cumsum(thirds) - thirds)
        self.ends = self.starts + HASHES * thirds
        n = int(HASHES * thirds.sum())
        self.counts, self.sums, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, times: np.ndarray) -> None:
        """Add digests ``times`` (plus or minus one) to their texts' sketches: one cell in each third."""
        third, start = self.thirds[owner], self.starts[owner]
        signed, checks = keys * times.astype(np.uint64), _check(keys) * times.astype(np.uint64)
        for j in range(HASHES):
            turn = np.uint64((self.seed * HASHES + j + 1) * 0xA0761D6478BD642F % 2**64)
            at = start + j * third + (mixed(keys + turn) % third.astype(np.uint64)).astype(np.int64)
            np.add.at(self.counts, at, times)
            np.add.at(self.sums, at, signed)
            np.add.at(self.checks, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take out cell contents that are a single digest, added or subtracted, until there are none: the digests,
        their texts and signs, and which texts' sketches are empty in the end, that is fully recovered."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(self.counts)
        while len(live):
            single = live[np.abs(self.counts[live]) == 1]
            sign = self.counts[single]
            keys = self.sums[single] * sign.astype(np.uint64)
            good = _check(keys) == self.checks[single] * sign.astype(np.uint64)
            if not good.any():
                break
            keys, sign, owner = keys[good], sign[good], np.searchsorted(self.ends, single[good], side="right")
            # the same digest may be alone in several of its cells
            _, first = np.unique(keys ^ mixed(owner.astype(np.uint64)), return_index=True)
            found.append((keys[first], owner[first], sign[first]))
            self.add(keys[first], owner[first], -sign[first])
            live = np.flatnonzero(self.counts)
        left = np.r_[0, np.cumsum((self.counts != 0) | (self.sums != 0) | (self.checks != 0))]
        done = left[self.ends] == left[self.starts]
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return *parts, done


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digests that only one text of a pair has, through the pairs' subtracted sketches: the digests, their pairs,
    and 1 for the left, -1 for the right text. Pairs whose peeling gets stuck are tried again at twice the size."""
    sizes = np.array([len(a) + len(b) for a, b in zip(left, right)], np.int64)
    pairs, thirds, seed = np.arange(len(sizes)), 4 + sizes // 4, 0
    out = []
    while len(pairs):
        both = Sketches(thirds[pairs], seed)
        for side, times in ((left, 1), (right, -1)):
            keys, owner = _flat([side[p] for p in pairs])
            both.add(keys, owner, np.full(len(keys), times))
        keys, owner, sign, done = both.peel()
        out.append((keys[done[owner]], pairs[owner[done[owner]]], sign[done[owner]]))
        pairs, seed = pairs[~done], seed + 1
        thirds = 2 * thirds
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common share of the paragraphs of each pair of texts, 1 if neither has any."""
    sizes = np.array([len(a) + len(b) for a, b in zip(left, right)], float)
    apart = np.bincount(differences(left, right)[1], minlength=len(sizes))
    return np.where(sizes > 0, (sizes - apart) / np.maximum(sizes + apart, 1), 1.0)


def packed(texts: list[np.ndarray]) -> list[bytes]:
    """The sketch that stands for each text: the number of its paragraphs and ``CELLS`` cells."""
    s = Sketches(np.full(len(texts), CELLS // HASHES))
    keys, owner = _flat(texts)
    s.add(keys, owner, np.ones(len(keys), np.int64))
    cells = np.stack([s.counts.astype(np.uint64), s.sums, s.checks]).reshape(3, -1, CELLS)
    return [len(t).to_bytes(4, "little") + cells[:, i].tobytes() for i, t in enumerate(texts)]


OUT = "doc_id long, n_chars long, edited_sha256 string, sketch binary, edited_sketch binary, near_edited double, near_next double"


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``bucket, copy, doc_id, text`` sorted by the first two and from the largest id down; a copy row closes its
    bucket with the first document of the next one."""
    held: tuple | None = None
    done = None  # the bucket that has met its closing row
    rows: list[tuple] = []

    def version(doc: tuple, after: tuple) -> tuple:
        _, doc_id, text, keys = doc
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[2][:cut]
        sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        return doc_id, len(text), sha, keys, digests(edited) if cut else keys, after[3]

    def batch() -> pa.RecordBatch:
        doc_id, n, sha, own, edited, after = (list(x) for x in zip(*rows))
        rows.clear()
        values = (doc_id, n, sha, packed(own), packed(edited), likeness(own, edited), likeness(own, after))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        return pa.record_batch([pa.array(x, t) for x, t in zip(values, kinds)], [x.split()[0] for x in OUT.split(", ")])

    for part in batches:
        for bucket, copy, doc_id, text in zip(*(part.column(i) for i in range(4))):
            bucket, text = bucket.as_py(), text.as_py() or ""
            if bucket == done:
                continue
            doc = (bucket, doc_id.as_py(), text, digests(text))
            if held is not None:
                rows.append(version(held, doc))
                if len(rows) >= 256:
                    yield batch()
            held, done = (None, bucket) if copy.as_py() else (doc, done)
    if rows:
        yield batch()


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketches of every text and of its edited version, and their likeness: columns ``OUT``.

    The edited version ends with the beginning of the next document in descending order of the id, null ids last; after
    the last comes the first. Rows with equal ids, or none, are ordered by a hash of their
    texts, then by the texts. A null text is empty; empty texts are
    alike. One document is its own next one; no document gives no row.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    wanted = min(MOST_BUCKETS, max(1, math.ceil(docs.count() / ROWS_A_BUCKET)))
    cuts = rows.where("doc_id is not null").approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.1 / wanted) if wanted > 1 else []
    cuts = sorted({int(x) for x in cuts})
    # buckets from the largest ids down; rows without id follow, spread and ordered by a hash of their text
    below = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: F.col("doc_id") <= c)) if cuts else F.lit(0)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn(
        "bucket",
        F.when(F.col("doc_id").isNotNull(), below).otherwise(len(cuts) + 1 + F.pmod("tie", F.lit(wanted))).cast("int"),
    )
    first = F.coalesce(F.max("doc_id"), F.min("tie")).alias("first")
    heads = {r.bucket: r.first for r in rows.groupBy("bucket").agg(first).collect()}  # at most 2 * MOST_BUCKETS numbers
    if not heads:
        return docs.sparkSession.createDataFrame([], OUT)
    order = sorted(heads)
    head = F.create_map(*(F.lit(x).cast(t) for b in order for x, t in ((b, "int"), (heads[b], "long"))))
    before = F.create_map(*(F.lit(x).cast("int") for i, b in enumerate(order) for x in (b, order[i - 1])))
    own = F.struct(F.col("bucket"), F.lit(False).alias("copy"))
    closing = F.struct(before[F.col("bucket")].alias("bucket"), F.lit(True).alias("copy"))
    is_head = F.coalesce("doc_id", "tie") == head[F.col("bucket")]
    dealt = rows.withColumn("to", F.explode(F.when(is_head, F.array(own, closing)).otherwise(F.array(own)))).select(
        "to.bucket", "to.copy", "doc_id", "text", "tie"
    )
    placed = (
        dealt.repartition("bucket")
        .sortWithinPartitions("bucket", "copy", F.desc_nulls_last("doc_id"), "tie", "text")
        .drop("tie")
    )
    return placed.mapInArrow(_versions, OUT)
