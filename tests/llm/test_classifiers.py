import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramlode.llm import quality, toxicity

def learn():
    return F.col("doc_id") % 5 != 0


@pytest.fixture(scope="module")
def marked(spark, words):
    """Junk texts shout or repeat, toxic ones hold an insult or one of its forms."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        body = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        junk, toxic = i % 4 == 0, i % 7 == 0
        if toxic:
            for _ in range(2):
                body.insert(rng.randrange(len(body)), "scumbag" + rng.choice(["", "s", "gy", "o"]))
        text = " ".join(w.upper() + "!!" if junk else w for w in body)
        docs.append((i, text, rng.choice(["en", "de", None]), "s", len(text)))
        labels.append((i, 0 if junk else 1, int(toxic)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "plain", "en", "s", 5)]
    labels += [(1000, None, None), (None, 1, 1), (7, 0, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def right(rows, labels, name, least):
    known = {r.doc_id: r[name] for r in labels.collect() if r.doc_id not in (None, 7, 1000)}
    held = [(r._score >= least) == known[r.doc_id] for r in rows if r.doc_id in known and r.doc_id % 5 == 0]
    return sum(held) / len(held)


def test_quality(marked):
    docs, labels = marked
    machine = quality.fit(docs, labels, "quality", learn())
    rows = quality.score(docs, machine, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(0 <= r._score <= 1 for r in rows)
    assert right(rows, labels, "quality", 0.3) > 0.95
    again = quality.fit(docs.repartition(5), labels, "quality", learn())
    assert np.array_equal(machine.w, again.w)
    assert quality.score(docs.limit(0), machine, ["doc_id"]).count() == 0


def test_linear_time_interactions():
    rng = np.random.default_rng(0)
    f = quality.features(pa.array(["a b c a", "", None, "B!! c"]), np.array([7.0, 0, np.nan, 5]))
    m = quality.Machine(0.1, rng.normal(0, 1, quality.BUCKETS + quality.STATS), rng.normal(0, 1, (quality.BUCKETS + quality.STATS, quality.RANK)), f.stats.mean(0), f.stats.std(0) + 1)
    row, at, x = quality._vectors(f, m.mean, m.scale)
    for i, got in enumerate(quality.scores(m, f)):
        a, v = at[row == i], x[row == i]
        z = m.bias + m.w[a] @ v + sum(m.v[a[p]] @ m.v[a[q]] * v[p] * v[q] for p in range(len(a)) for q in range(p))
        assert abs(got - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_toxicity(marked):
    docs, labels = marked
    model = toxicity.fit(docs, labels, learn())
    rows = toxicity.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == docs.count()
    assert right(rows, labels, "toxic", 0.5) > 0.95
    empty = {r._score for r in rows if r.doc_id in (1000, 1001)}
    assert len(empty) == 1
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_convolution_is_the_plain_one():
    rng = np.random.default_rng(3)
    net = toxicity.Net(rng.normal(0, 1, (toxicity.TABLE, toxicity.DIM)), rng.normal(0, 1, (6, toxicity.DIM, toxicity.FILTERS)), rng.normal(0, 1, toxicity.OUT), np.zeros(toxicity.OUT), 0.0)
    lengths = [1, 2, 3, 9]
    ids = rng.integers(0, toxicity.TABLE, (sum(lengths), 3))
    first = np.cumsum([0, *lengths[:-1]])
    got = toxicity._pooled(net, toxicity.project(net), ids, first)
    for i, (a, n) in enumerate(zip(first, lengths)):
        e = np.r_[net.table[ids[a : a + n]].sum(1), np.zeros((3, toxicity.DIM))]
        want = []
        for k, width in enumerate(toxicity.WIDTHS):
            w = [net.filters[s] for s, (x, _) in enumerate(toxicity._SLICES) if x == k]
            want.append(np.max([sum(e[t + j] @ w[j] for j in range(width)) for t in range(n)], axis=0))
        assert np.allclose(got[i], np.maximum(np.concatenate(want) + net.shift, 0), atol=1e-4)


def test_one_label_only(marked, spark):
    docs, labels = marked
    ones = labels.where("quality = 1")
    rows = quality.score(docs, quality.fit(docs, ones, "quality", learn()), ["doc_id"]).collect()
    assert len({round(r._score, 9) for r in rows}) == 1
    none = toxicity.fit(docs, labels.limit(0), learn())
    assert len({round(r._score, 9) for r in toxicity.score(docs, none, ["doc_id"]).collect()}) == 1


def test_thresholds_by_language():
    s, y = np.array([0.1, 0.2, 0.3, 0.9] * 30), np.array([0, 0, 1, 1] * 30)
    out = toxicity.calibrated(s, y, ["de"] * 120)
    assert 0.2 < out["de"] <= 0.3
    assert toxicity.calibrated(s[:4], y[:4], ["de"] * 4) == {}


def test_thresholds_count_all_labelled_rows(spark, words):
    """One toxic text in ten says what clean ones say too: over all rows the fewest mistakes are to let the word pass,
    in a sample of as many toxic as clean rows they are not. The rare language has too few rows in the sample."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 10 == 0
        said = "scumbag" if toxic or rng.random() < 0.3 else ""
        docs.append((i, " ".join([rng.choice(words), said, rng.choice(words)]), "de" if i % 25 in (0, 1) else "en"))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), bound=60)
    flagged = toxicity.score(frame, model, ["lang"]).where(F.col("_score") >= toxicity.threshold(model, F.col("lang")))
    assert flagged.where("lang = 'en'").count() < 150
    assert set(model.thresholds) == {"de", "en"}
    counted = toxicity._counted(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), "toxic", model, 60)
    assert sum(r.n for r in counted.collect()) == 1500 - 120
    toxicity_most, toxicity.MOST_BROADCAST = toxicity.MOST_BROADCAST, 0
    try:
        again = toxicity._counted(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), "toxic", model, 60)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, counted.collect()))
    finally:
        toxicity.MOST_BROADCAST = toxicity_most


def test_tasks_train_and_not_the_driver(marked, monkeypatch):
    """The driver holds the models only: nothing is trained in its process, and what tasks train is what it gets."""
    docs, labels = marked

    driver = os.getpid()

    def elsewhere(train):
        def run(*args):
            assert os.getpid() != driver, "trained by the driver"
            return train(*args)

        return run

    want = [quality.fit(docs, labels, "quality", learn()), toxicity.fit(docs, labels, learn()).net]
    monkeypatch.setattr(quality, "train", elsewhere(quality.train))
    monkeypatch.setattr(toxicity, "train", elsewhere(toxicity.train))
    got = [quality.fit(docs, labels, "quality", learn()), toxicity.fit(docs, labels, learn()).net]
    for a, b in zip(want, got):
        assert all(np.array_equal(x, y) for x, y in zip(a, b)) and np.any(a[1])


def test_the_net_is_sent_to_the_tasks_once(marked, spark, monkeypatch):
    """Calibrating and scoring share one broadcast: copies of the net in the driver do not add up."""
    docs, labels = marked
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(1) or broadcast(self, value))
    model = toxicity.fit(docs, labels, learn())
    for _ in range(2):
        assert toxicity.score(docs, model, ["doc_id"]).count() == docs.count()
    assert len(sent) == 1
