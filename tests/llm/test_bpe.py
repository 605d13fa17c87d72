import time

import numpy as np
import pyarrow as pa
import tiktoken

from gramlode.llm import bpe


def test_ids_are_those_of_the_library(docs, no_docs):
    ranks, pattern = bpe.default_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    rows = sorted((r.key is None, r.key or 0, bytes(r.decoded).decode(), list(r.ids), r.n_tokens) for r in bpe.encode(docs).collect())
    assert len(rows) == len(texts)
    for (none, key, text), (got_none, got_key, back, ids, n) in zip(texts, rows):
        assert (got_none, got_key, back, ids) == (none, key, text, library.encode_ordinary(text)) and n == len(ids)
    assert bpe.encode(no_docs).count() == 0


def test_other_vocabulary(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    frame = spark.createDataFrame([(1, "abc aaaa bcbc abab"), (2, "")], "doc_id long, text string")
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    got = {r.key: list(r.ids) for r in bpe.encode(frame, ranks=ranks, pattern=r"\S+|\s+").collect()}
    assert got == {1: library.encode_ordinary("abc aaaa bcbc abab"), 2: []}


def test_blocks_share_their_words(spark, docs, monkeypatch):
    """Small blocks, whose table of words begins anew now and then, give the ids of one block."""
    key = lambda r: (r.key is None, r.key or 0, list(r.ids))
    whole = sorted(map(key, bpe.encode(docs.coalesce(1)).collect()))
    ranks, pattern = bpe.default_ranks()
    tokens, codes = bpe.token_table(ranks)
    words = [["ab", "cd", "ab"], [], ["ef", "ab"], ["cd", "gh"]]
    batch = pa.record_batch([pa.array(range(4), pa.int64()), pa.array(words)], ["key", "words"])
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 2)
    monkeypatch.setattr(bpe, "TABLE_WORDS", 2)
    blank = np.full((256, 256), ord(bpe.NONE), np.uint32)
    blocks = list(bpe._gather(np.arange(1, 257, dtype=np.uint32), blank, tokens, codes)([batch]))
    rows = [r for b in blocks for r in b.to_pylist()]
    assert [r["keys"] for r in rows] == [[0], [1, 2], [3]]
    assert [r["fresh"] for r in rows] == [True, False, True]
    assert [np.frombuffer(r["places"], np.int32).tolist() for r in rows] == [[0, 1, 0], [2, 0], [0, 1]]
    assert whole == sorted(map(key, bpe.encode(docs.repartition(7)).collect()))


def test_steps_after_the_last_merge_cost_little(spark):
    """A long word without any merge is looked at once, not at every step of the fold."""
    ranks = {bytes([b]): b for b in range(256)}
    frame = spark.createDataFrame([(1, "xy" * 10_000)], "doc_id long, text string")
    begin = time.time()
    (row,) = bpe.encode(frame, ranks=ranks, pattern=r"\S+").collect()
    assert list(row.ids) == [120, 121] * 10_000 and time.time() - begin < 8


def test_pairs_that_share_a_bucket_are_told_apart(spark, monkeypatch):
    """Every pair finds its own merge, and pairs that do not merge find none, however many share a bucket."""
    monkeypatch.setattr(bpe, "_BUCKETS", 4)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"cab": 260}
    want = {bpe._MARK + chr(a + 1) + chr(b + 1): chr(rank + 1) for a, b, rank in zip(*(x.tolist() for x in bpe.pairs(ranks)))}
    none = [bpe._MARK + x for x in ("ba", bpe.EDGE + "b", "c" + bpe.EDGE, bpe.NONE + "b")]
    frame = spark.createDataFrame([(pair,) for pair in [*want, *none]], "pair string")
    table = bpe._literal_map(bpe.rank_map(ranks))
    got = {r.pair: r.merge for r in frame.select("pair", bpe._look_up(table, frame.pair).alias("merge")).collect()}
    assert got == want | dict.fromkeys(none, bpe.NONE)
    rows = spark.createDataFrame([(1, "abc aaaa bcbc cabcab")], "doc_id long, text string")
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    (row,) = bpe.encode(rows, ranks=ranks, pattern=r"\S+|\s+").collect()
    assert list(row.ids) == library.encode_ordinary("abc aaaa bcbc cabcab")


def test_the_plan_does_not_hold_the_ranks(docs):
    """The table of ranks goes to the tasks with their function: the driver's plans stay small."""
    plan = bpe.encode(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
