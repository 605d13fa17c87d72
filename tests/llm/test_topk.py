import math

import numpy as np
import pytest

from gramlode.llm import topk


def test_same_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    rng = np.random.default_rng(0)
    vectors = [rng.normal(0, 0.3, 16).astype(np.float32).tolist() for _ in range(300)]
    vectors[7], vectors[8], vectors[50] = vectors[9], vectors[9], vectors[9]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [None] * 16), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (None, vectors[0]), (950, [0.5] * 3), (951, [0.25] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score")
    q = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for a in (x for x in q if x % 50 == 0):
        scores = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a and len(q[b]) == len(q[a]))
        want += [(a, i + 1, b, -s) for i, (s, b) in enumerate(scores[:5])]
    got = topk.top_k(frame, frame.where("vec_id % 50 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    rows = [(50, [1.0, 0.0]), (50, None), (50, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [3.0, 1.0])]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        frame = spark.createDataFrame(order, "vec_id long, embedding array<double>").coalesce(1)
        found = topk.top_k(frame, frame.where("vec_id % 50 = 0")).collect()
        assert [(r.query_id, r["rank"], r.id, r.score) for r in found] == [(50, 1, 1, 3 * 256 * 256), (50, 2, 2, 256 * 256)]


def test_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(50, [5000.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="1048576"):
        topk.top_k(frame, frame).collect()


def test_blocks_meet_without_rows_of_pairs(spark, explain, monkeypatch):
    """A row that holds a block of candidates beside one of queries is repeated for every such pair."""
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.3, (200, 9)).astype(np.float32)
    vectors[20:60] = vectors[3]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = topk.top_k(frame, frame.where("vec_id % 5 = 0"))
    assert "Join" not in explain(found)
    q = np.floor(256 * vectors.astype(float)).astype(int)
    want = []
    for a in range(0, 200, 5):
        best = sorted((-int(q[a] @ q[b]), b) for b in range(200) if b != a)[:5]
        want += [(a, i + 1, b, -s) for i, (s, b) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
