import pytest
from pyspark.sql import functions as F

from gramlode.functions.inflect import IRREGULAR, other_number, singular
from gramlode.operators import dictionary as d


def flip(spark, words, irregular=IRREGULAR):
    df = spark.createDataFrame([(w,) for w in words], "w string").withColumn("one", singular("w"))
    return {r.w: r.f for r in df.select("w", other_number("w", "one", irregular).alias("f")).collect()}


PAIRS = {
    "battery": "batteries",
    "box": "boxes",
    "glass": "glasses",
    "switch": "switches",
    "wish": "wishes",
    "car": "cars",
    "day": "days",
    "house": "houses",
    "gas": "gases",
    "bus": "buses",
    "analysis": "analyses",
}


def test_flip_is_its_own_inverse(spark):
    assert flip(spark, PAIRS) == PAIRS
    assert flip(spark, PAIRS.values()) == {v: k for k, v in PAIRS.items()}


def test_flip_edges(spark):
    assert flip(spark, ["", "y", "ties", "virus", "class"]) == {
        "": "s",
        "y": "ys",
        "ties": "tie",
        "virus": "viruses",
        "class": "classes",
    }


def test_more_irregular_words(spark):
    assert flip(spark, ["man", "men"], {"man": "men", "men": "man"}) == {"man": "men", "men": "man"}


def forms(spark, base, **options):
    df = spark.createDataFrame([(base,)], "base string")
    return sorted(r.surface for r in d.with_forms(df, **options).collect())


@pytest.mark.parametrize(
    ("base", "want"),
    [
        ("solar", ["solar"]),
        ("reactor", ["reactor", "reactors"]),
        ("smart grid", ["smart grid", "smart grids", "smarts grid", "smarts grids"]),
        ("heat pump unit", ["heat pump", "heat pumps", "heats pump", "heats pumps"]),
        ("reactor ", ["reactor ", "reactor s"]),
        ("a  b c", ["a ", "a s", "as ", "as s"]),
    ],
)
def test_forms(spark, base, want):
    assert forms(spark, base) == want


def test_forms_without_inflection(spark):
    assert forms(spark, "solar", inflect=False) == ["solar"]
    assert forms(spark, "reactor", inflect=False) == []


def test_keyword_dict(spark):
    sheets = d.literal_sheets(spark, {"a": ["wind_power2", "wind_power", "PV 3"], "b": ["wind_power"]})
    got = sorted((r.tech, r.base) for r in d.keyword_dict(sheets).collect())
    assert got == [("a", "PV "), ("a", "wind power"), ("b", "wind power")]
    sizes = {r.tech: r.n_words for r in d.dict_size(d.keyword_dict(sheets)).collect()}
    assert sizes == {"a": 2, "b": 1}


def test_last_sheet_wins_a_shared_form(spark):
    first = d.literal_sheets(spark, {"x": ["windmills", "windmill"], "y": ["windmill"]})
    got = {r.surface: r.base for r in d.surface_dict(d.keyword_dict(first)).collect()}
    assert got == {"windmill": "windmill", "windmills": "windmill"}
    second = d.literal_sheets(spark, {"x": ["windmill"], "y": ["windmills"]})
    got = {r.surface: r.base for r in d.surface_dict(d.keyword_dict(second)).collect()}
    assert got == {"windmill": "windmills", "windmills": "windmills"}
    unordered = d.keyword_dict(second).drop("tech_pos")
    got = {r.surface: r.base for r in d.surface_dict(unordered).collect()}
    assert got == {"windmill": "windmills", "windmills": "windmills"}


def test_matcher_joins_every_technology(spark):
    keywords = d.keyword_dict(d.literal_sheets(spark, {"a": ["solar"], "b": ["solar"]}))
    rows = d.matcher(d.surface_dict(keywords), keywords).orderBy("tech").collect()
    assert [tuple(r) for r in rows] == [("solar", "solar", "a"), ("solar", "solar", "b")]


def test_sheets_from_folders(spark, tmp_path):
    from gramlode.sources.tables import read_keyword_sheets

    sheets = d.literal_sheets(spark, {"b": ["x_y1", "z"], "a": ["z"]})
    sheets.select("tech", F.col("raw").alias("bigrams")).write.partitionBy("tech").option("header", True).csv(
        str(tmp_path / "s")
    )
    got = read_keyword_sheets(spark, str(tmp_path / "s"), order=["b", "a"])
    assert sorted(map(tuple, got.collect())) == [("a", 2, "z"), ("b", 1, "x_y1"), ("b", 1, "z")]
