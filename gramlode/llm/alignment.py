"""Cross-tokenizer alignment by white-space anchors.

Two tokenizers encode every whole text. Where a token of either begins with a space and both have just ended at the same
byte (a verified shared end), the text is cut: between two such anchors lies a window of token ids, mostly one word.
Windows are aligned once per pair of id tuples and remembered, so a frequent word costs a look-up.

A window's alignment is the groups between shared ends, and the links, the token pairs that end together. Linked tokens
are one the suffix of the other, so the vocabularies bound how many different pairs there can be, whatever the corpus:
counts of pairs over the corpus are a vector of that length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import byte_slices, give_back
from gramlode.session import scratch_path

SPACE = "▁"
#: What either tokenizer may take for white space, and more.
_WHITE = r"\s᠎​﻿"
_NEXT_TO_WHITE = re.compile(f"[{_WHITE}] | [{_WHITE}]")
_CUT = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
#: Characters of words, and bytes of windows' ids and groups, after which a worker's memory begins anew; words encoded by
#: one call.
MEMO_CHARS, MEMO_BYTES, TOGETHER = 2_500_000, 24 << 20, 1000
#: Bytes of text, and links, handled at once (one text may have more).
SLICE_BYTES, SLICE_LINKS = 1 << 20, 1 << 18


def byte_letters() -> dict[str, int]:
    """Byte of every letter of a byte-level vocabulary: visible Latin-1 characters stand for themselves, the other bytes,
    in order, for the characters from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_vocabulary(path: str) -> list[bytes]:
    """Bytes of every token of a byte-level BPE file, by id."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary = content["model"]["vocab"] | {t["content"]: t["id"] for t in content.get("added_tokens", [])}
    letters = byte_letters()
    tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for name, i in vocabulary.items():
        tokens[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
    return tokens


def piece_vocabulary(path: str) -> list[bytes]:
    """Bytes of every piece of a sentence-piece model, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = model.id_to_piece(list(range(model.vocab_size())))
    if any(SPACE in name.lstrip(SPACE) for name in names):
        raise ValueError("a piece has a space behind another character: words cannot be encoded apart")
    return [
        bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)
    ]


def default_paths() -> tuple[str, str]:
    """The byte-level and the piece vocabulary installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Every pair of tokens that can end together, as ``a * len(b) + b`` in order: one is the suffix of the other."""

    def suffixes(of: list[bytes], among: list[bytes], least: int) -> Iterator[tuple[int, int]]:
        ids: dict[bytes, list[int]] = {}
        for i, token in enumerate(among):
            if token:
                ids.setdefault(token, []).append(i)
        for i, token in enumerate(of):
            for cut in range(least, len(token)):
                for j in ids.get(token[cut:], ()):
                    yield i, j

    found = [x * len(b) + y for x, y in suffixes(a, b, 0)] + [x * len(b) + y for y, x in suffixes(b, a, 1)]
    return np.unique(np.array(found, np.int64))


def words(text: str) -> list[str]:
    """A text, with a space put in front, cut before every single space between two other characters; without the spaces.
    No token of either tokenizer crosses such a cut."""
    if _NEXT_TO_WHITE.search(text) is None and text[:1] not in ("", " ") and not text.endswith(" ") and not text[0].isspace():
        return text.split(" ")
    first, *others = _CUT.split(" " + text)
    return [first[1:], *others]


def _joined(pieces: list[bytes], ids: list[int]) -> bytes:
    return b"".join([pieces[i] for i in ids])


class Runs:
    """Runs of numbers one after the other, run ``i`` at ``begin[i]`` to ``begin[i + 1]``."""

    def __init__(self, kind: type) -> None:
        self.values, self.begin = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, ends: np.ndarray) -> None:
        self.begin = np.append(self.begin, len(self.values) + ends)
        self.values = np.append(self.values, values)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen runs one after the other, and where each ends."""
        begin = self.begin[which]
        sizes = self.begin[which + 1] - begin
        ends = np.cumsum(sizes)
        return self.values[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class Aligner:
    """Both tokenizers and what a worker remembers: the ids of words, and the alignments of windows."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_level_vocabulary(path_a), piece_vocabulary(path_b)
        self.size_a, self.size_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.space_a, self.space_b = (np.array([t[:1] == b" " for t in v]) for v in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = (list(map(str, range(len(v)))) for v in (self.bytes_a, self.bytes_b))
        self.pairs = possible_pairs(self.bytes_a, self.bytes_b)
        self.forget_words()
        self.forget_windows()

    def forget_words(self) -> None:
        self.words: dict[str, int] = {}
        self.ids_a, self.ids_b, self.other, self.chars = Runs(np.uint32), Runs(np.uint32), set(), 0

    def forget_windows(self) -> None:
        self.windows: dict[tuple[bytes, bytes], int] = {}
        self.groups, self.links, self.held = [], Runs(np.int32), 0

    def learn(self, new: list[str]) -> None:
        """Encode words that are not known, together. Those whose tokens' bytes are not the word's count as ``other``."""
        text = " ".join(new)
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text, num_threads=1)
        whole = b" " + text.encode()
        if _joined(self.bytes_a, a) == whole == _joined(self.bytes_b, b):
            ends = np.cumsum([len(word.encode()) + 1 for word in new])
            for runs, ids, size in ((self.ids_a, a, self.size_a), (self.ids_b, b, self.size_b)):
                ids = np.array(ids, np.uint32)
                runs.add(ids, np.searchsorted(np.cumsum(size[ids]), ends, "right"))
        elif len(new) > 1:
            for word in new:
                self.learn([word])
            return
        else:
            self.other.add(len(self.words))
            self.ids_a.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))
            self.ids_b.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.chars += len(text)

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of each whole text by both tokenizers, none if either does not give the text back, one text after the
        other, and where they end: ``ids_a, ids_b, ends_a, ends_b``."""
        if self.chars > MEMO_CHARS:
            self.forget_words()
        cut = [words(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        codes = list(map(self.words.get, flat))
        missing = [i for i, code in enumerate(codes) if code is None]
        new = list(dict.fromkeys([flat[i] for i in missing]))
        for at in range(0, len(new), TOGETHER):
            self.learn(new[at : at + TOGETHER])
        for i in missing:
            codes[i] = self.words[flat[i]]
        codes, ends = np.array(codes, np.int64), np.cumsum([len(c) for c in cut])
        if self.other:
            text_of = np.repeat(np.arange(len(cut)), np.diff(ends, prepend=0))
            good = np.ones(len(cut), bool)
            good[text_of[np.isin(codes, list(self.other))]] = False
            codes, ends = codes[good[text_of]], np.cumsum(np.diff(ends, prepend=0) * good)
        out = []
        for runs in (self.ids_a, self.ids_b):
            ids, upto = runs.take(codes)
            out.append((ids, np.append(0, upto)[ends]))
        return out[0][0], out[1][0], out[0][1], out[1][1]

    def learn_windows(self, new: list[tuple[bytes, bytes]]) -> None:
        """Align windows of token ids; the bytes of both sides are the same."""
        ids_a, ids_b = (np.frombuffer(b"".join([key[side] for key in new]), np.uint32) for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        # tokens that end together; windows do, so that no group reaches over a window's end
        at_b = np.searchsorted(ends_b, ends_a)
        at_a = np.flatnonzero(ends_b[at_b] == ends_a)
        at_b = at_b[at_a]
        pair = ids_a[at_a].astype(np.int64) * len(self.bytes_b) + ids_b[at_b]
        names_a, names_b = list(map(self.names_a.__getitem__, ids_a.tolist())), list(map(self.names_b.__getitem__, ids_b.tolist()))
        groups, i, j = [], 0, 0
        for k, m in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
            left = names_a[i] if k - i == 1 else ",".join(names_a[i:k])
            right = names_b[j] if m - j == 1 else ",".join(names_b[j:m])
            groups.append(f"{left}|{right}")
            i, j = k, m
        last = np.cumsum([len(key[0]) // 4 for key in new]) - 1
        upto = np.searchsorted(at_a, last) + 1
        self.links.add(np.searchsorted(self.pairs, pair).astype(np.int32), upto)
        cuts = [0, *upto.tolist()]
        self.windows.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        self.groups += [";".join(groups[begin:end]) for begin, end in zip(cuts, cuts[1:])]
        self.held += 4 * (len(ids_a) + len(ids_b) + len(pair)) + 12 * len(groups) + 32 * len(new)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """``n_a, n_b, groups`` of each text, and all links by their place among the possible pairs and where each
        text's end."""
        ids_a, ids_b, ends_a, ends_b = self.encoded(texts)
        at_a, at_b = (np.append(0, np.cumsum(size[ids])) for size, ids in ((self.size_a, ids_a), (self.size_b, ids_b)))
        # anchors: ends that both share, each in front of a token of its own with a space; the texts' bytes are the same
        # in both, and every text begins with a space, so that a text's begin is an anchor too
        spaced_a, spaced_b = np.flatnonzero(self.space_a[ids_a]), np.flatnonzero(self.space_b[ids_b])
        if len(spaced_b):
            place = np.minimum(np.searchsorted(at_b[spaced_b], at_a[spaced_a]), len(spaced_b) - 1)
            shared = at_b[spaced_b][place] == at_a[spaced_a]
            spaced_a, spaced_b = spaced_a[shared], spaced_b[place[shared]]
        from_a, from_b = np.append(spaced_a, len(ids_a)), np.append(spaced_b, len(ids_b))
        cuts_a, cuts_b, a, b = (from_a * 4).tolist(), (from_b * 4).tolist(), ids_a.tobytes(), ids_b.tobytes()
        if self.held > MEMO_BYTES:
            self.forget_windows()
        keys = [(a[i:j], b[k:m]) for i, j, k, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])]
        codes = list(map(self.windows.get, keys))
        missing = [i for i, code in enumerate(codes) if code is None]
        if missing:
            self.learn_windows(list(dict.fromkeys([keys[i] for i in missing])))
            for i in missing:
                codes[i] = self.windows[keys[i]]
        names = list(map(self.groups.__getitem__, codes))
        links, upto = self.links.take(np.array(codes, np.int64))
        last = np.searchsorted(from_a, ends_a)
        cuts = [0, *last.tolist()]
        groups = [";".join(names[begin:end]) for begin, end in zip(cuts, cuts[1:])]
        return np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0), groups, links, np.append(0, upto)[last]


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Aligner(path_a, path_b)


def _align_rows(paths: tuple[str, str], digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        aligner = _aligner(*paths)
        for part in (part for batch in batches for part in byte_slices(batch, 1, SLICE_BYTES)):
            n_a, n_b, groups, links, ends = aligner.align(part.column(1).to_pylist())
            n_groups = [g.count("|") for g in groups]
            if digests:
                groups = [sha256(g.encode()).hexdigest() if g else "" for g in groups]
            offsets = np.append(0, ends).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(groups, pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(links))],
                ["key", "n_a", "n_b", "n_groups", "groups", "links"],
            )
            pa.default_memory_pool().release_unused()
        give_back()

    return run


def align(
    docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None, digests: bool = False
) -> DataFrame:
    """``key, n_a, n_b, n_groups, groups, links`` of every row.

    ``groups`` is ``a1,a2|b1;a3|b2``, the ids of both tokenizers between shared ends (with ``digests`` its SHA-256, or ''),
    ``links`` the pairs of tokens that end together, by their place in ``possible_pairs``. Both tokenizers see a space and
    the text, without special tokens. A text that is null or empty, or that either tokenizer does not give back byte for
    byte, has no tokens: zeros, no groups, no links. Ids are kept as they are, null ones too; repeated rows give equal
    rows; no rows give no rows. Other columns are not looked at. One run without single spaces (a megabyte of base64) is
    encoded in one call.
    """
    chosen = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(
        _align_rows(paths or default_paths(), digests),
        "key long, n_a long, n_b long, n_groups long, groups string, links array<int>",
    )


def _link_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``SLICE_LINKS`` links; one row may have more."""
    ends = np.cumsum(np.asarray(batch.column(column).value_lengths()).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        limit = (ends[begin - 1] if begin else 0) + SLICE_LINKS
        end = max(begin + 1, int(np.searchsorted(ends, limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in (part for whole in batches for part in _link_slices(whole, 0)):
        n = np.bincount(np.asarray(batch.column(0).flatten()))
        total = np.pad(total, (0, max(len(n) - len(total), 0)))
        total[: len(n)] += n
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])


def pair_counts(alignments: DataFrame) -> DataFrame:
    """``pair, n``: how often each pair is linked in all rows of ``align``. Counted in each task first."""
    counted = alignments.select("links").mapInArrow(_count_links, "pair int, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(alignments: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The rows of ``align`` with ``n_links, n_best, count_sum`` in place of the links: how many links there are, how many
    of them have the highest count of their second token over all rows (ties included), and the sum of their counts.

    Read twice, so give a stored table. The counts are collected and sent to all tasks: there are no more of them than
    possible pairs, which the two vocabularies bound (about half a million, 5 MB, for the installed ones).
    """
    a, b = paths or default_paths()
    second = len(piece_vocabulary(b))
    pairs = possible_pairs(byte_level_vocabulary(a), piece_vocabulary(b))
    rows = pair_counts(alignments).toArrow()
    counts = np.zeros(len(pairs), np.int64)
    counts[np.asarray(rows["pair"])] = np.asarray(rows["n"])
    of = pairs % second
    highest = np.zeros(second, np.int64)
    np.maximum.at(highest, of, counts)
    sent = alignments.sparkSession.sparkContext.broadcast((counts, counts == highest[of]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in (part for whole in batches for part in _link_slices(whole, 5)):
            links = batch.column(5)
            sizes = np.asarray(links.value_lengths()).astype(np.int64)
            flat, ends = np.asarray(links.flatten()), np.r_[0, np.cumsum(sizes)]
            sums = [np.r_[0, np.cumsum(x)] for x in (best[flat].astype(np.int64), counts[flat])]
            n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sizes), pa.array(n_best), pa.array(count_sum)],
                [*batch.schema.names[:5], "n_links", "n_best", "count_sum"],
            )

    return alignments.select("key", "n_a", "n_b", "n_groups", "groups", "links").mapInArrow(
        run, "key long, n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long"
    )


def linked_corpus(docs: DataFrame, paths: tuple[str, str] | None = None, digests: bool = True, **columns: str) -> DataFrame:
    """``align`` and ``with_counts`` over all rows; the alignments are written once in between, since the counts need all."""
    path = scratch_path(docs.sparkSession, "alignments")
    found = align(docs, paths=paths, digests=digests, **columns)
    found.write.option("compression", "zstd").parquet(path)
    return with_counts(docs.sparkSession.read.schema(found.schema).parquet(path), paths)


def token_bytes(first: bool, ids: Column, paths: tuple[str, str] | None = None) -> Column:
    """The bytes of a column of id arrays, as binary pieces put together."""
    path = (paths or default_paths())[0 if first else 1]
    names = (byte_level_vocabulary if first else piece_vocabulary)(path)
    table = F.split(F.lit(",".join(t.hex() for t in names)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i.cast("int") + 1)), ""))
