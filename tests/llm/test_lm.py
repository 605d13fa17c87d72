import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramlode.llm import lm
from gramlode.llm import tokens as tokens_of_blocks
from gramlode.llm.common import held_out

def fold():
    return held_out(F.col("doc_id"), 7, 2)


def tokens(text):
    return (text or "").encode().lower().split() + [None]


@pytest.fixture(scope="module")
def scored(docs):
    return lm.score(docs, fold()).collect()


def test_counts_and_base(docs, scored):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, text in rows:
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(text))
        want[i, held(i), len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), n, round(base, 6)] += 1
    got = Counter((r.key, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert got == want


def test_model_beats_the_base_on_held_out_texts(spark, scored):
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.held_out: r for r in lm.perplexity(lm.score(prose, fold())).collect()}
    assert rows[True].perplexity < rows[True].base_perplexity and rows[True].texts > 0
    assert all(r.score < 0 for r in scored)


def test_small_head_gives_the_same_counts(docs, scored, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 40)
    again = lm.score(docs, fold()).collect()
    pick = lambda rows: sorted((r.key or -1, r.n_known, round(r.base_score, 6)) for r in rows)
    assert pick(again) == pick(scored)


def test_symbol_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(1)
    rows = {(int(a), int(b)): int(n) for a, b, n in zip(rng.integers(0, 20, 200), rng.integers(0, 60, 200), rng.integers(1, 50, 200))}
    pairs = spark.createDataFrame([(a, b, n) for (a, b), n in rows.items()], "context int, symbol int, n long")
    p = 10.0 ** lm.symbol_table(pairs)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3)
    assert (p > 0).all()


def test_gibbs_keeps_every_customer():
    n = np.array([1.0, 2, 7, 500])
    r = lm.Restaurant(n, np.full(4, 0.25), 0.5, np.random.default_rng(0))
    for _ in range(200):
        r.step()
        assert (np.bincount(r.dish, r.size) == n).all() and (r.size > 0).all()
    assert (r.tables() <= n).all()
    assert r.averaged().sum() > len(n)


def test_no_rows(no_docs):
    assert lm.score(no_docs, fold()).count() == 0


def one_by_one(n, p, d, sweeps, rng):
    """Tables of all dishes, customers being seated anew one at a time; averaged over the second half of the sweeps."""
    tables, found = [[1] * int(min(x, 2)) for x in n], []
    for t, x in zip(tables, n):
        t[0] += int(x) - sum(t)
    for sweep in range(sweeps):
        for i in rng.permutation(np.repeat(np.arange(len(n)), n.astype(int))):
            t = tables[i]
            t[rng.choice(len(t), p=np.array(t) / sum(t))] -= 1
            t[:] = [x for x in t if x]
            new, stay = (lm.CONCENTRATION + d * sum(map(len, tables))) * p[i], sum(t) - d * len(t)
            if rng.random() * (new + stay) < new:
                t.append(1)
            else:
                t[rng.choice(len(t), p=(np.array(t) - d) / stay)] += 1
        found.append(sum(map(len, tables)))
    return np.mean(found[sweeps // 2 :])


@pytest.mark.parametrize("d, known", [(0.6, (4096, 256)), (0.2, (4096, 256)), (0.6, (4, 4))])
def test_as_many_tables_as_seated_one_by_one(d, known, monkeypatch):
    monkeypatch.setattr(lm, "MOST_KNOWN", known)
    n, p = np.r_[np.full(5, 25.0), np.full(5, 3.0), np.full(5, 1.0)], np.r_[np.full(5, 0.08), np.full(10, 0.01)]
    want = one_by_one(n, p, d, 400, np.random.default_rng(3))
    found = np.mean([lm.Restaurant(n, p, d, np.random.default_rng(i)).averaged().sum() for i in range(20)])
    assert abs(found / want - 1) < (0.1 if known[0] > 25 else 0.25)


def test_pairs_of_rare_words_are_learned(spark):
    """Beyond the symbols too: a pair that was seen is likelier than the same words in pairs that were not."""
    texts = [f"w{i}x w{i}y" for i in range(4000)] + ["w7x w7y", "w7x w9y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.key: r.score for r in lm.score(rows, F.col("doc_id") >= 4000).collect()}
    assert found[4000] > found[4001] + 1


def test_frequent_first_words_in_several_buckets(docs, scored, monkeypatch):
    monkeypatch.setattr(lm, "DEALT", 3000)
    again = lm.score(docs, fold()).collect()
    place = lambda rows: sorted((r.key or -1, r.n_known, round(r.base_score, 6)) for r in rows)
    assert place(again) == place(scored)
    assert abs(sum(r.score for r in again) / sum(r.score for r in scored) - 1) < 0.05


def test_context_reaches_over_a_cut(monkeypatch):
    column = pa.array(["a b c d e f g h", None, "x y"] * 3)
    columns = lambda: [np.concatenate(x) for x in zip(*lm.sequences(column))]
    whole = columns()
    monkeypatch.setattr(tokens_of_blocks, "BLOCK", 4)
    assert all((a == b).all() for a, b in zip(whole, columns()))
