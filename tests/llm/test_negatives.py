import math
import random

import numpy as np
import pytest

from gramlode.llm import negatives

KINDS = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, positives=5, hard=5, least=80, scale=256):
    """All scores of all anchors."""
    good = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    out = []
    for at, (i, v, label) in enumerate(good):
        if i % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), j, same == label) for k, (j, w, same) in enumerate(good) if k != at and len(w) == len(v)
        )
        for p, j, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and least * -p <= 100 * -s[0] <= 100 * -p][:hard]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, dims, rng, labels):
    centres = np.random.default_rng(1).normal(size=(labels, dims))
    out = []
    for i in range(n):
        label = rng.randrange(labels)
        v = np.random.default_rng(i).normal(size=dims) * 0.3 + centres[label if rng.random() < 0.7 else rng.randrange(labels)] * 0.1
        out.append((i * 5, [float(x) for x in v], label))
    return out


@pytest.mark.parametrize("dims", [1, 7, 64])
def test_against_all_scores(spark, monkeypatch, dims):
    monkeypatch.setattr(negatives, "ROWS", 37)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = random.Random(dims)
    rows = vectors(500, dims, rng, 4)
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, 1), (200, [nan] * dims, 1), (300, [inf] + [0.0] * (dims - 1), 2), (400, [0.5] * dims, None), (None, [0.5] * dims, 1)]
    rows += [rows[20], rows[20], rows[21], (500, [], 1), (501, [], 2), (502, [], 1), (7000, [0.0] * (dims + 1), 1), (800, [None] * dims, 1)]
    rows += [(9000 + i, rows[40][1], 3) for i in range(60)]  # ties
    frame = spark.createDataFrame(rows, KINDS).selectExpr("*", "1 as row", "2 as id", "'x' as slot", "3 as dims").repartition(3)
    found = negatives.mine(frame)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = (np.floor(rng.normal(size=(50, n)) * 300) for n in (20, 90))
    exact, width = a.T @ b, np.inf
    for x, y in zip(negatives.summaries(a), negatives.summaries(b)):
        low, high = negatives.bounds(x, negatives.Summary(*(v.astype(np.float32).astype(float) for v in y)))
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low).mean() < width
        width = (high - low).mean()
    assert [len(x) for x in negatives.levels(64)] == [1, 4, 16] and [len(x) for x in negatives.levels(3)] == [1]


def test_far_blocks_are_not_scored():
    rng = np.random.default_rng(5)
    data = np.floor(np.c_[rng.normal(size=(64, 30)) * 5 + 100, rng.normal(size=(64, 30)) * 5 - 100])
    block = negatives.Block(np.arange(60), np.arange(60), np.zeros(60, int), data, negatives.summaries(data))
    one = negatives.Block(np.array([99]), np.array([100]), np.zeros(1, int), data[:, :1], negatives.summaries(data[:, :1]))
    allowed = np.ones((1, 60), bool)
    left = negatives.survivors(one, block, allowed, lambda low, high, alive: high >= np.sort(low, axis=1)[:, -5:-4])
    assert left.sum() < 31 and not left[0, 30:].any()


def test_large_components_and_no_rows(spark):
    assert negatives.mine(spark.createDataFrame([], KINDS)).count() == 0
    big = spark.createDataFrame([(100, [1e9], 1)], KINDS)
    with pytest.raises(Exception, match="16777216"):
        negatives.mine(big).collect()
