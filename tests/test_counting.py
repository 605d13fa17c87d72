import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gramlode.operators import counting, membership, sizing
from gramlode.operators import dictionary as d
from gramlode.session import stored

SHEETS = {"green": ["solar", "wind_power1", "reactor"], "other": ["solar", "heat pump unit"]}
FILL = ["lorem"] * 51


def advert(*words):
    return " ".join([*FILL, *words, "ipsum", *FILL])


# (file, number, id): ids repeat on purpose
ADVERTS = [
    ("a.zip", 0, "0", advert("solar", "wind", "power", "solar", "winds", "powers")),
    ("a.zip", 1, "0", advert("reactors", "reactor", "heat", "pumps")),
    ("a.zip", 2, "7", advert("nothing", "here")),
    ("b.zip", 0, "0", "solar solar"),  # too short
    ("b.zip", 1, "9", advert("solar")),
]
KEY = ["source_file", "record_no"]


@pytest.fixture(scope="module")
def dims(spark):
    keywords = stored(d.keyword_dict(d.literal_sheets(spark, SHEETS)), "keywords")
    surfaces = stored(d.surface_dict(keywords), "surfaces")
    return keywords, surfaces, stored(d.matcher(surfaces, keywords), "matches")


@pytest.fixture(scope="module")
def adverts(spark):
    rows = [(*a, f"title, {a[2]}", 'occ "x"') for a in ADVERTS]
    return spark.createDataFrame(
        rows, "source_file string, record_no int, JobID string, JobText string, CanonJobTitle string, BGTOcc string"
    ).repartition(3)


def plain_counts(dims):
    """The counts with dictionaries and Counters."""
    keywords, surfaces, _ = dims
    base_of = {r.surface: r.base for r in surfaces.collect()}
    techs = {}
    for r in keywords.collect():
        techs.setdefault(r.base, []).append(r.tech)
    want = Counter()
    for file, number, _, text in ADVERTS:
        tokens = re.findall("[a-z]+", text)
        tokens = tokens[51:-51] if len(tokens) > 102 else []
        for gram in tokens + [" ".join(p) for p in zip(tokens, tokens[1:])]:
            for tech in techs.get(base_of.get(gram), []):
                want[(file, number, tech, base_of[gram])] += 1
    return want


def as_counter(df):
    return Counter({(r.source_file, r.record_no, r.tech, r.base): r.n for r in df.collect()})


@pytest.mark.parametrize("join", [{"small": True}, {"small": False}, {}])
def test_keyword_counts(spark, dims, adverts, join):
    want = plain_counts(dims)
    assert want[("a.zip", 0, "green", "wind power")] == 2
    assert want[("a.zip", 1, "other", "heat pump unit")] == 1
    assert as_counter(counting.keyword_counts(adverts, dims[2], KEY, "JobText", **join)) == want


def test_same_id_stays_apart(dims, adverts):
    rows = counting.keyword_counts(adverts, dims[2], KEY, "JobText", carry=["JobID"]).where("JobID = '0'").collect()
    assert {(r.source_file, r.record_no) for r in rows} == {("a.zip", 0), ("a.zip", 1)}


@pytest.fixture
def every_advert_looked_at(monkeypatch):
    monkeypatch.setattr(counting, "HOT_SAMPLE", 1)


def test_hot_grams_do_not_move(spark, dims, explain, every_advert_looked_at):
    rare = ["reactors", "heat pump"]
    rows = [(i, advert(*["solar"] * 40, *([rare[i // 50 % 2]] if i % 50 == 0 else []))) for i in range(300)]
    many = spark.createDataFrame(rows, "id int, JobText string")
    counted = counting.keyword_counts(many, dims[2], ["id"], "JobText", small=False)
    want = Counter({(tech, "solar", 40): 300 for tech in ("green", "other")})
    want.update({("green", "reactor", 1): 3, ("other", "heat pump unit", 1): 3})
    assert Counter((r.tech, r.base, r.n) for r in counted.collect()) == want
    shown = explain(counted)
    assert "Union" in shown and "SortMergeJoin Inner" in shown and "BroadcastHashJoin Inner" in shown
    assert "explode(sequence" not in shown  # nothing of the dictionary is repeated
    # the hot part is counted before it moves: no exchange between its join and the partial count
    hot, cold = shown.split("(1)")[0].split("BroadcastHashJoin")[0], shown.split("(1)")[0].split("SortMergeJoin")[0]
    assert hot.count("Exchange") == 1 < 1 + cold.count("Exchange")


def test_no_hot_gram_and_no_filter(dims, adverts, explain, monkeypatch):
    monkeypatch.setattr(counting, "heavy_hitters", lambda *_: [])
    monkeypatch.setattr(counting, "bloom_filter", lambda *_: None)
    rows = counting.keyword_counts(adverts, dims[2], KEY, "JobText", small=False)
    assert as_counter(rows) == plain_counts(dims)
    assert "BroadcastExchange" not in explain(rows)


def test_heavy_hitters(spark):
    df = spark.range(100_000).selectExpr("case when id % 3 = 0 then 'hot' when id % 500 = 1 then 'warm' else 'x' || id end as v")
    assert sorted(sizing.heavy_hitters(df, "v")) == ["hot", "warm"]
    assert sizing.heavy_hitters(df, "v", 0.01) == ["hot"]
    assert sizing.heavy_hitters(df.where("false"), "v") == []


def test_bloom_filter(spark, monkeypatch):
    keys = spark.range(0, 20_000, 2).selectExpr("id as a", "'k' || id as b")
    bloom = membership.bloom_filter(keys, "a", "b")
    held = spark.range(20_000).selectExpr("id as a", "'k' || id as b").where(bloom.may_hold("a", "b"))
    assert held.where("a % 2 = 0").count() == 10_000 and held.count() < 11_000
    assert spark.range(9).where(membership.bloom_filter(keys.where("false"), "a").may_hold("id")).count() == 0
    monkeypatch.setattr(membership, "MOST_WORDS", 16)
    assert membership.bloom_filter(keys, "a") is None


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_hashed_forms(spark, n):
    name = lambda i: "".join("abcdefghij"[int(d)] for d in str(i)) + (" tail" if i % 3 == 0 else "")
    forms = [name(i) for i in range(n)]
    table = spark.createDataFrame([(f,) for f in [*forms, *forms[:5], "No form", "a,b", "x|y", ""]], "form string")
    held = membership.hashed_forms(table, "form")
    asked = [*forms, "zz", "tail", "No form", "", None] + [name(i) for i in range(n, n + 500)]
    rows = spark.createDataFrame([(a,) for a in asked], "asked string").where(held.holds(F.col("asked"))).collect()
    assert sorted(r.asked for r in rows) == sorted(forms)


def test_keys_fetch_texts_through_a_filter(dims, adverts, explain, monkeypatch):
    monkeypatch.setattr(counting, "INLINE_FORMS", 0)
    want = {(r.source_file, r.record_no) for r in counting.adverts_with_hits(adverts, dims[1], KEY, "JobText").collect()}
    monkeypatch.setattr(counting, "fits_broadcast", lambda df, **_: False)
    rows = counting.adverts_with_hits(adverts, dims[1], KEY, "JobText")
    assert {(r.source_file, r.record_no) for r in rows.collect()} == want
    tree = explain(rows)
    assert "scalar-subquery" in tree.lower() or "Subquery" in tree
    assert "BroadcastExchange" not in tree


def test_size_check(spark):
    df = spark.range(1000).selectExpr("repeat('x', 100) as surface", "id")
    assert sizing.fits_broadcast(df)
    assert not sizing.fits_broadcast(df, rows=999)
    assert not sizing.fits_broadcast(df, size=100_000)


def test_surface_and_gram_counts(dims, adverts):
    surface = {(r.source_file, r.record_no, r.gram): r.n for r in counting.surface_counts(adverts, dims[1], KEY, "JobText").collect()}
    assert surface[("a.zip", 0, "winds powers")] == 1 and surface[("a.zip", 0, "solar")] == 2
    grams = {(r.source_file, r.record_no, r.gram): r.n for r in counting.gram_counts(adverts, KEY, "JobText").collect()}
    assert grams[("a.zip", 0, "power solar")] == 1 and ("b.zip", 0, "solar") not in grams
    assert all(grams[key] == n for key, n in surface.items())


def test_gram_counts_shuffle_the_text_only(adverts, explain):
    shown = explain(counting.gram_counts(adverts, KEY, "JobText"))
    tree = shown[: shown.index("(1)", shown.index("(1)") + 1)]
    assert tree.index("Generate") < tree.index("Exchange")  # the exchange is below the explode


@pytest.mark.parametrize("few", [0, 64])
def test_wide_and_long_agree(dims, adverts, few, monkeypatch):
    monkeypatch.setattr(counting, "FEW_COLUMNS", few)
    bases = sorted({r.base for r in dims[0].collect()})
    counts = counting.keyword_counts(adverts, dims[2], KEY, "JobText")
    from_counts = counting.wide_counts(counts, bases, [*KEY, "tech"])
    from_hits = counting.wide_counts(counting.hits(adverts, dims[2], KEY, "JobText"), bases, [*KEY, "tech"], n=None)
    assert from_counts.columns == [*KEY, "tech", *bases]
    assert sorted(map(str, from_counts.collect())) == sorted(map(str, from_hits.collect()))
    assert as_counter(counting.long_counts(from_counts, bases, [*KEY, "tech"])) == as_counter(counts)


def test_techs_and_adverts_with_hits(dims, adverts, monkeypatch):
    techs = counting.advert_techs(counting.hits(adverts, dims[2], KEY, "JobText"), KEY).collect()
    assert {(r.source_file, r.record_no): r.techs for r in techs} == {
        ("a.zip", 0): ["green", "other"],
        ("a.zip", 1): ["green", "other"],
        ("b.zip", 1): ["green", "other"],
    }
    inline = counting.adverts_with_hits(adverts, dims[1], KEY, "JobText")
    assert inline.columns == adverts.columns
    monkeypatch.setattr(counting, "INLINE_FORMS", 0)
    joined = counting.adverts_with_hits(adverts, dims[1], KEY, "JobText")
    assert sorted(map(str, inline.collect())) == sorted(map(str, joined.select(*inline.columns).collect()))
    assert inline.count() == 3


def sample_key(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8]


@pytest.mark.parametrize("p", [1.0, 0.5, 0.1])
def test_snippets(dims, adverts, p, monkeypatch):
    arguments = (KEY, "JobText", "JobID", "CanonJobTitle", "BGTOcc", p)
    inline = counting.snippets(adverts, dims[2], *arguments)
    monkeypatch.setattr(counting, "INLINE_FORMS", 0)
    joined = counting.snippets(adverts, dims[2], *arguments)
    rows = sorted(map(tuple, inline.collect()))
    assert rows == sorted(map(tuple, joined.collect()))
    want = {k for k in plain_counts(dims) if p >= 1 or int(sample_key(*k), 16) < int(p * 2**32)}
    assert {(r[0], r[1], r[2], r[4]) for r in rows} == want
    assert len(rows) == len(want)


def test_inline_snippets_move_sampled_texts_only(dims, adverts, explain):
    shown = explain(counting.snippets(adverts, dims[2], KEY, "JobText", "JobID", "CanonJobTitle", "BGTOcc"))
    assert "md5" in shown and "SortMergeJoin" not in shown


def test_text_of_a_task_is_bounded(spark):
    from gramlode.session import spread_by_size

    rows = spark.createDataFrame([(i % 300, "x" * 1000) for i in range(600)], "id int, text string")
    placed = spread_by_size(rows, "text", "id", size=10_000)
    assert placed.rdd.getNumPartitions() == 60 and placed.count() == 600
    sizes = [sum(len(r.text) for r in part) for part in placed.rdd.glom().collect()]
    assert max(sizes) < 40_000
    assert spread_by_size(rows.where("false"), "text", "id").count() == 0
    grams = counting.gram_counts(rows.limit(0), ["id"], "text")
    assert grams.count() == 0


def test_adverts_with_a_hot_word_make_no_grams(spark, monkeypatch):
    """With a dictionary beyond the plan, also where keys repeat or are null and texts are null."""
    monkeypatch.setattr(counting, "_in_dictionary", lambda surfaces: None)
    monkeypatch.setattr(counting, "HOT_SAMPLE", 1)
    filler = "filler " * 60
    texts = [filler + f"common word{chr(97 + i % 26)} " + filler for i in range(40)]
    texts += [filler + "rare pair " + filler, filler + "nothing " + filler, None, "common", filler + "common " + filler]
    rows = [(i, t) for i, t in enumerate(texts)] + [(41, filler + "common " + filler), (None, filler + "common " + filler)]
    adverts = spark.createDataFrame(rows, "id int, text string")
    surfaces = stored(spark.createDataFrame([("common",), ("rare pair",), ("absent",)], "surface string"), "surfaces")
    made = []
    hits = counting.hits
    monkeypatch.setattr(counting, "hits", lambda left, *a, **k: made.append(left.count()) or hits(left, *a, **k))
    got = counting.adverts_with_hits(adverts, surfaces, ["id"], "text").collect()
    assert sorted(r.id for r in got) == sorted([*range(40), 40, 41, 41, 44])
    assert made and made[0] <= 4


def test_snippets_of_all_hits_move_no_text(spark, explain):
    """Every hit is found in its advert's row; only adverts that share a key are looked at together."""
    words = " ".join(["fill"] * 60 + ["grid", "grids", "grid", "wind"] + ["fill"] * 60)
    matches = spark.createDataFrame([("grid", "grid", "a"), ("grids", "grid", "a"), ("grid", "grid", "b"), ("wind", "wind", "a")], "surface string, base string, tech string")
    rows = [(1, words), (2, words), (2, words), (None, words), (None, words), (4, "fill"), (5, None)]
    adverts = spark.createDataFrame(rows, "id long, body string").withColumns({"title": F.lit("t"), "place": F.lit("p")})
    hits = [("a", "grid"), ("a", "wind"), ("b", "grid")]
    found = counting.snippets(adverts, matches, ["id"], "body", "id", "title", "place", 1.0)
    got = sorted((r.id or 0, r.tech, r.keyword) for r in found.where(F.col("jobtext") == words).collect())
    assert found.count() == 9 and got == sorted((i, *hit) for i in (0, 1, 2) for hit in hits)
    unique = adverts.where("id in (1, 4, 5)")
    shown = explain(counting.snippets(unique, matches, ["id"], "body", "id", "title", "place", 1.0))
    assert "hashpartitioning" not in shown and "SortAggregate" not in shown
