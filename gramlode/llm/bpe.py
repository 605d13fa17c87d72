"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

Texts are split by the tokenizer's pattern. The distinct words of a task's documents go through the merges once: Spark
higher-order functions fold over a word's array of byte tokens, each step joining the first pair of lowest rank, until
no pair has one. Documents come in blocks of bounded size; a block brings the words that the ones before it had not. The ranks come with a block, so that the plan and the driver do not hold them: every pair of
tokens whose bytes together are a token, in the bucket of its hash, so that a look-up is one array access and a search in a short text. Documents then take the ids of their words; decoding concatenates the
binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import give_back

#: White space as Unicode has it; Java's own class knows the ASCII ones only.
_SPACE = r"\t-\r \u0085   -     　"
#: Tokens are written as characters: id plus one as the code point, below the surrogates for vocabularies up to 55,000.
#: ``EDGE`` stands at both ends of a word and is no token; ``NONE`` sorts behind every token.
EDGE, NONE = "\ue000", "\uffff"
MOST_TOKENS = 55_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, one token a line: base64, space, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def default_ranks() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the 50k vocabulary installed on this machine."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def java_pattern(pattern: str) -> str:
    """The pattern with white space written out."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")


#: Buckets of the table of pairs, and what stands in front of each of a bucket's pairs.
_BUCKETS = 1 << 18
_MARK = "\ue001"


def pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left token, right token and rank of every two tokens that together are a token."""
    out = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    return tuple(np.array(out, np.int64).T.reshape(3, -1))


def rank_map(ranks: dict[bytes, int]) -> list[str]:
    """Pairs by their hash: a bucket is ``NONE``, then a mark, a pair and its merged token for each pair that falls there.
    Ids count from one here, as the characters do."""
    if max(ranks.values(), default=-1) >= MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens")
    out = [NONE] * _BUCKETS
    for a, b, rank in zip(*(x.tolist() for x in pairs(ranks))):
        pair = f"{_MARK}{chr(a + 1)}{chr(b + 1)}"
        out[zlib.crc32(pair.encode()) % _BUCKETS] += pair + chr(rank + 1)
    return out


def _literal_map(ranks: list[str]) -> Column:
    """The table as an array literal, for small ones: the optimizer folds the text into the array once, and the plan holds it."""
    return F.split(F.lit(EDGE.join(ranks)), EDGE)


def _with(value: Column, body) -> Column:
    """Bind a value for use in several places of an expression, which would evaluate it at each."""
    return F.transform(F.array(value), body)[0]


def _look_up(table: Column, pair: Column) -> Column:
    """The character of the merged token of a marked pair, ``NONE`` if it does not merge, as with an ``EDGE``: what follows the
    pair in its bucket, or the bucket's beginning."""
    bucket = table[F.crc32(pair.cast("binary")).bitwiseAND(_BUCKETS - 1)]
    return F.left(F.call_function("substring_index", bucket, pair, F.lit(-1)), F.lit(1))


def merged(word: Column, table: Column) -> Column:
    """Fold the merges over one word ``struct(t, r)``: its tokens' characters between two edges, and the characters that
    its neighbours merge to, the edges' included. A step joins the first pair of lowest rank; when none is left the second
    text becomes empty, and the steps that remain have nothing to look at."""

    def step(state: Column, _: Column) -> Column:
        t, r = state["t"], state["r"]

        def join(low: Column) -> Column:
            def at(i: Column) -> Column:
                mark, one = F.lit(_MARK), F.lit(1)
                sides = F.array(F.concat(mark, F.substring(t, i - 1, one), low), F.concat(mark, low, F.substring(t, i + 2, one)))
                merges = F.array_join(F.transform(sides, lambda pair: _look_up(table, pair)), "")
                return F.struct(
                    F.overlay(t, low, i, F.lit(2)).alias("t"), F.overlay(r, merges, i - 1, F.lit(3)).alias("r")
                )

            done = F.struct(t.alias("t"), F.lit("").alias("r"))
            return F.when(low == NONE, done).otherwise(_with(F.instr(r, low), at))

        return F.when(r == "", state).otherwise(_with(F.array_min(F.split(r, "")), join))

    steps = F.sequence(F.lit(1), F.greatest(F.char_length(word["t"]) - 3, F.lit(1)))
    return F.aggregate(steps, word, step, lambda s: F.substring(s["t"], F.lit(2), F.char_length(s["t"]) - 2))


def encoded_words(words: Column, ranks: Column) -> Column:
    """The tokens of each word, one character each."""
    return _with(ranks, lambda table: F.transform(words, lambda w: merged(w, table)))


#: ``fresh``: the table of distinct words begins anew with this block.
BLOCK = "fresh boolean, keys array<long>, sizes binary, places binary, words array<struct<t string, r string>>, ranks array<string>"
#: Words of a block (one document may have more), and distinct words after which the table begins anew.
BLOCK_WORDS, TABLE_WORDS = 1 << 19, 1 << 19


def _block_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.list_value_length(batch.column(1)).fill_null(0))
    begin = 0
    while begin < batch.num_rows:
        held = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, held + BLOCK_WORDS, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _gather(byte_code: np.ndarray, pair_code: np.ndarray, tokens: pa.Array, codes: np.ndarray, ranks: pa.Array = pa.array([], pa.string())):  # noqa: B008
    """Rows ``key, words`` to one row per block: keys, words a document, the place of every word among the distinct ones,
    and the distinct words that are new, as ``merged`` takes them. ``byte_code``, ``pair_code``: characters of single bytes, and of
    what two bytes merge to. A word that is one of ``tokens`` is that token, whatever its merges: ``codes`` has its
    character. ``ranks`` goes along with every block."""

    def strings(codes: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Runs of characters that end at ``ends``, without an object for each."""
        data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
        sizes = np.cumsum(1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800), dtype=np.int32)
        offsets = np.r_[np.int32(0), sizes[ends - 1]].astype(np.int32)
        return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.array([], pa.large_binary())
        for batch in (part for whole in batches for part in _block_slices(whole)):
            lists = batch.column(1)
            coded = pc.dictionary_encode(lists.flatten())
            words = coded.dictionary.cast(pa.large_binary())
            if len(seen) > TABLE_WORDS:
                seen = seen[:0]
            fresh = not len(seen)
            known = pc.index_in(words, seen)
            new = np.asarray(known.is_null())
            table_place = np.array(known.fill_null(0), np.int32)
            table_place[new] = np.arange(len(seen), len(seen) + new.sum())
            words = words.filter(pa.array(new))
            seen = pa.concat_arrays([seen, words])
            n = len(words)
            offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1] if n else np.zeros(1, np.int64)
            data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
            sizes = np.diff(offsets)
            whole = np.asarray(pc.fill_null(pc.index_in(words, tokens), -1))
            begins = np.cumsum(sizes) - sizes
            single = np.repeat(whole >= 0, sizes)  # bytes of words that are tokens: the first one stands for the word
            chars = byte_code[data]
            chars[begins[whole >= 0]] = codes[whole[whole >= 0]]
            kept = ~single
            kept[begins] = True
            lengths = np.where(whole >= 0, 1, sizes)
            ends = np.cumsum(lengths + 2)
            t = np.full(kept.sum() + 2 * n, ord(EDGE), np.uint32)
            inner = np.ones(len(t), bool)
            inner[ends - 1] = inner[ends - lengths - 2] = False
            t[inner] = chars[kept]
            r_ends = np.cumsum(lengths + 1)
            r = np.full(kept.sum() + n, ord(NONE), np.uint32)
            inner = np.ones(len(r), bool)
            inner[r_ends - 1] = inner[r_ends - lengths - 1] = False
            if len(data) > 1:
                neighbours = ~single[:-1]
                neighbours[begins[1:] - 1] = False  # words meet, but do not merge
                r[inner] = pair_code[data[:-1][neighbours], data[1:][neighbours]]
            split = pa.StructArray.from_arrays([strings(t, ends), strings(r, r_ends)], ["t", "r"])
            del t, r, inner, data, chars, single, kept
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([fresh]),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                    pa.array([np.asarray(lists.value_lengths().fill_null(0), np.int64).tobytes()], pa.binary()),
                    pa.array([table_place[np.asarray(coded.indices)].tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), split),
                    pa.ListArray.from_arrays(pa.array([0, len(ranks)], pa.int32()), ranks),
                ],
                ["fresh", "keys", "sizes", "places", "words", "ranks"],
            )
            del lists, coded, words, split, known, new, table_place
            give_back()

    return run


def token_table(ranks: dict[bytes, int]) -> tuple[pa.Array, np.ndarray]:
    """The tokens' bytes and, at the same places, their characters."""
    return pa.array(ranks.keys(), pa.large_binary()), np.fromiter(ranks.values(), np.uint32, len(ranks)) + 1


def decode(text: str, pieces: dict[str, bytes]) -> bytes:
    """The bytes of tokens written as characters: their binary pieces one after the other."""
    return b"".join([pieces[c] for c in text])


def _spread(pieces: dict[str, bytes], digests: bool):
    """The ids of every document of a block, and what they decode to; or the digests of both. Each distinct word's ids are
    written out, and its pieces put together, once."""
    names = {c: str(ord(c) - 1) for c in pieces}

    def objects(values: list) -> np.ndarray:
        return np.array([*values, None], object)[:-1]

    def known(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, decoded bytes and number of tokens of words."""
        if digests:
            ids = [names[t] if len(t) == 1 else " ".join([names[c] for c in t]) for t in tokens]
        else:
            ids = tokens
        back = [pieces[t] if len(t) == 1 else decode(t, pieces) for t in tokens]
        return objects(ids), objects(back), np.fromiter(map(len, tokens), np.int64, len(tokens))

    def rows(keys: pa.Array, begin: int, ends: np.ndarray, places: np.ndarray, table: tuple) -> pa.RecordBatch:
        all_ids, all_back, n, at = [], [], [], begin
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for end in ends.tolist():
            own = places[at:end]
            at = end
            ids, back = (" " if digests else "").join(table[0][own]), b"".join(table[1][own])
            n.append(int(table[2][own].sum()))
            all_ids.append(sha(ids.encode()) if digests else np.frombuffer(ids.encode("utf-32-le"), "<u4").astype(np.int32) - 1)
            all_back.append(sha(back) if digests else back)
        kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(n, pa.int64()), *(pa.array(x, t) for x, t in zip((all_ids, all_back), kinds))],
            ["key", "n_tokens", "ids", "decoded"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known([])
        for batch in batches:
            for fresh, keys, sizes, places, tokens in zip(*batch.columns):
                ends = np.cumsum(np.frombuffer(sizes.as_py(), np.int64))
                new = known(tokens.values.to_pylist())
                table = new if fresh.as_py() else tuple(np.concatenate(x) for x in zip(table, new))
                held = np.frombuffer(places.as_py(), np.int32)
                for a in range(0, len(ends), 500):
                    yield rows(keys.values[a : a + 500], int(ends[a - 1]) if a else 0, ends[a : a + 500], held, table)
            give_back()
        table = None
        give_back()

    return run


def encode(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    ranks: dict[bytes, int] | None = None,
    pattern: str | None = None,
    digests: bool = False,
) -> DataFrame:
    """``key, n_tokens, ids, decoded`` of every row: the ids of its whole text without special tokens, and the bytes that
    they decode to; with ``digests`` the SHA-256 of the decimal ids joined by one space, and of the bytes.

    A null or empty text has no tokens. Ids are kept as they are, null ones too; repeated rows give equal rows; no rows
    give no rows. Other columns are not looked at. The default is the installed 50k vocabulary and its pattern.
    """
    if ranks is None:
        ranks, pattern = default_ranks()
    single = [bytes([b]) for b in range(256)]
    byte_code = np.array([ranks[b] + 1 for b in single], np.uint32)
    pair_code = np.array([[ranks[a + b] + 1 if a + b in ranks else ord(NONE) for b in single] for a in single], np.uint32)
    pieces = {chr(rank + 1): token for token, rank in ranks.items()}
    words = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    split = docs.select(F.col(f"`{key}`").cast("long").alias("key"), words.alias("words"))
    blocks = split.mapInArrow(_gather(byte_code, pair_code, *token_table(ranks), pa.array(rank_map(ranks), pa.string())), BLOCK)
    folded = blocks.select("fresh", "keys", "sizes", "places", encoded_words(F.col("words"), F.col("ranks")).alias("tokens"))
    kinds = ("string", "string") if digests else ("array<int>", "binary")
    return folded.mapInArrow(_spread(pieces, digests), f"key long, n_tokens long, ids {kinds[0]}, decoded {kinds[1]}")


def encoded_digests(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs``."""
    out = encode(docs, digests=True, **options)
    return out.select(
        F.col("key").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256")
    )
