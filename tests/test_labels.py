import math
import os

import numpy as np
import pytest

from gramlode.operators import labels as lb
from gramlode.session import stored


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(1, "Wind and sun. Wind!"), (2, ""), (3, "nothing of note")], "id int, text string"
    ).repartition(2)


def rows_by_doc(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((r.label, r.score, r["rank"]))
    return out


def test_shares_and_ranks(docs):
    got = rows_by_doc(lb.label_scores(docs, ["solar sun", "wind power", "", "tidal"], ["id"], "text"))
    n = len("Wind and sun. Wind!")
    powers = [math.exp(100 * k / n) for k in (2, 1, 0)]
    assert [x[0] for x in got[1]] == ["wind power", "solar sun", "tidal"]
    assert [x[1] for x in got[1]] == pytest.approx([p / sum(powers) for p in powers])
    assert [x[0] for x in got[2]] == ["solar sun", "wind power", "tidal"]  # a tie keeps the order of the labels
    for entries in got.values():
        assert sum(x[1] for x in entries) == pytest.approx(1)
        assert [x[2] for x in entries] == [1, 2, 3]


def test_model_in_place_of_the_word_rate(docs):
    def score(texts, labels):
        return [[900.0 + len(t) * i for i in range(len(labels))] for t in texts]

    got = rows_by_doc(lb.label_scores(docs, ["a", "b"], ["id"], "text", lb.model_scorer(score)))
    assert [x[0] for x in got[1]] == ["b", "a"] and [x[0] for x in got[2]] == ["a", "b"]
    assert got[1][0][1] == pytest.approx(1 / (1 + math.exp(-19)))


def test_no_join_and_no_shuffle(spark, explain, tmp_path):
    spark.createDataFrame([(1, "x")], "id int, text string").write.parquet(str(tmp_path / "d"))
    shown = explain(lb.label_scores(spark.read.parquet(str(tmp_path / "d")), ["a", "b"], ["id"], "text"))
    assert "Join" not in shown and "Exchange" not in shown


def test_label_file(spark, tmp_path):
    from gramlode.sources.tables import read_labels

    (tmp_path / "labels.txt").write_bytes(b"wind power\r\nsmart grids\r\n\r\n nuclear\r\n")
    assert [tuple(r) for r in read_labels(spark, str(tmp_path / "labels.txt")).collect()] == [
        ("labels.txt", 0, "wind power"),
        ("labels.txt", 1, "smart grids"),
        ("labels.txt", 3, " nuclear"),
    ]


def test_lines_keep_their_order(spark, docs, tmp_path):
    from gramlode.plans.jobs import rank_labels

    names = [f"tie {i}" for i in range(300)]
    (tmp_path / "many.txt").write_text("\n".join(names))
    rows = rank_labels(spark, docs, str(tmp_path / "many.txt"), ["id"], "text").where("id = 2").orderBy("rank").collect()
    assert [r.label for r in rows] == names


loads = []


def counting_model(folder):
    """Notes every load and every call's bytes in a folder."""
    loads.append(folder)
    with open(f"{folder}/{os.getpid()}-load-{len(loads)}", "w"):
        pass

    def score(texts, labels):
        with open(f"{folder}/{os.getpid()}-calls", "a") as f:
            f.write(f"{sum(map(len, texts))} {len(texts)}\n")
        return [[float(len(t) * i) for i in range(len(labels))] for t in texts]

    return score


def test_model_is_loaded_once_and_fed_in_bounded_batches(spark, tmp_path):
    rows = [(i, "x" * 100, i) for i in range(500)] + [(900, "y" * 5000, 0), (901, None, 0)]
    docs = spark.createDataFrame(rows, "id int, text string, raw int").repartition(4)
    scorer = lb.loaded_scorer(counting_model, str(tmp_path), batch_bytes=1000)
    for _ in range(2):
        got = rows_by_doc(lb.label_scores(docs.drop("raw"), ["a", "b"], ["id"], "text", scorer))
    assert len(got) == 502 and [x[0] for x in got[900]] == ["b", "a"] and [x[0] for x in got[901]] == ["a", "b"]
    processes = {name.split("-")[0] for name in os.listdir(tmp_path)}
    assert sum("-load-" in name for name in os.listdir(tmp_path)) == len(processes)
    sizes = [tuple(map(int, line.split())) for p in tmp_path.glob("*-calls") for line in p.read_text().splitlines()]
    assert max(s for s, _ in sizes) < 1000 + 5000 and max(n for s, n in sizes if s < 1200) <= 11


def test_model_with_too_few_scores(docs):
    bad = lb.model_scorer(lambda texts, labels: [[1.0]] * len(texts))
    with pytest.raises(Exception, match="must give 2 scores"):
        lb.label_scores(docs, ["a", "b"], ["id"], "text", bad).collect()


def test_best_of_many_labels(spark):
    names = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} tail" for i in range(400)] + ["Wind wind power", "sun", "..."]
    labels = stored(spark.createDataFrame(list(enumerate(names)), "pos long, label string"), "labels")
    texts = ["wind sun wordaa Wordaa wordzz", "", None, "tail " * 9, "nothing of note", "sun " + " ".join(names[3:9])]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    want = rows_by_doc(lb.label_scores(docs.where("text is not null"), names, ["id"], "text"))
    for k in (1, 10, 600):
        got = rows_by_doc(lb.top_labels(docs, labels, ["id"], "text", k))
        assert {i: [(x[0], x[2]) for x in rows] for i, rows in got.items() if i != 2} == {i: [(x[0], x[2]) for x in rows[:k]] for i, rows in want.items()}
        assert all(x[1] == pytest.approx(y[1]) for i, rows in want.items() for x, y in zip(got[i], rows))
        assert [x[0] for x in got[2]] == names[:k]  # a null text has no words


@pytest.mark.parametrize("entries", [lb.INDEX_ENTRIES, 0])
def test_many_labels_of_a_frequent_word(spark, monkeypatch, entries):
    """A text meets few of the labels of a frequent word one by one, also when its words and its row repeat."""
    monkeypatch.setattr(lb, "INDEX_ENTRIES", entries)
    met = []
    slices = lb._slices
    monkeypatch.setattr(lb, "_slices", lambda *a: met.append(slices(*a)) or met[-1])
    word = lambda i: chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676)
    names = [f"the {word(i)}" for i in range(700)] + [f"{word(i)} {word(i + 1)} the" for i in range(0, 600, 7)] + ["...", "the"]
    labels = stored(spark.createDataFrame(list(enumerate(names)), "pos long, label string"), "labels")
    texts = ["the the " + word(7), "the " * 50, f"{word(14)} {word(15)} {word(699)}", "nothing", "", word(3) + " the of " * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    want = rows_by_doc(lb.label_scores(docs, names, ["id"], "text"))
    for k in (1, 10, 900):
        got = rows_by_doc(lb.top_labels(docs, labels, ["id"], "text", k))
        for i, rows in want.items():
            assert [(x[0], x[2]) for x in got[i]] == [(x[0], x[2]) for x in rows[:k]]
            assert all(x[1] == pytest.approx(y[1]) for x, y in zip(got[i], rows))
    if entries:
        at = {w: i for i, w in enumerate(sorted({w for n in names for w in lb._words(n)}))}
        pairs = [(at[w], p) for p, n in enumerate(names) for w in lb._words(n)]
        index = lb._Index(np.array([w for w, _ in pairs]), np.array([p for _, p in pairs]), len(at), len(names))
        met.clear()
        lb._best(index, np.array([at["the"]]), np.array([50]), 200, 10, np.zeros(len(at), int), np.zeros(len(names), int))
        assert sum(len(x) for x, _ in met) <= 20  # of 788 labels with that word
