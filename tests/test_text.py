import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gramlode.functions import text as tx


def column(spark, values, name="text", kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} {kind}").repartition(2)


def by_id(df, name):
    return [row[name] for row in df.orderBy("id").collect()]


def plain_tokens(text):
    return re.findall("[a-z]+", text.lower())


def plain_trim(tokens):
    """51 off the front; off the back what lies from 51 before the end of the shortened list."""
    if len(tokens) <= 100:
        return []
    rest = tokens[51:]
    cut = len(rest) - 51
    return rest[:cut]  # a negative cut takes from the end


def test_clean_tokens(spark):
    texts = ["", "Solar  PV-cells!", "línea\nnew\tline 42x", "ÀB c'est", "   ", "x" * 3 + "É" + "y"]
    assert by_id(tx.with_clean_tokens(column(spark, texts), ["id"], "text"), "tokens") == [
        plain_tokens(t) for t in texts
    ]


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(alphabet="aBz Éß\n-'9,İ", max_size=30), min_size=1, max_size=30))
def test_clean_tokens_any_text(spark, texts):
    got = by_id(tx.with_clean_tokens(column(spark, texts), ["id"], "text"), "tokens")
    assert got == [plain_tokens(t) for t in texts]


def test_trim_every_length(spark):
    lists = [[f"w{i}" for i in range(n)] for n in range(211)]
    df = column(spark, lists, "tokens", "array<string>")
    got = by_id(df.select("id", tx.trim_boilerplate("tokens").alias("kept")), "kept")
    assert got == [plain_trim(tokens) for tokens in lists]
    assert [len(got[n]) for n in (100, 101, 102, 103, 104)] == [0, 49, 0, 1, 2]


def test_ngrams(spark):
    lists = [[], ["a"], ["a", "b"], ["a", "b", "a", "b"]]
    df = column(spark, lists, "tokens", "array<string>")
    for n in (1, 2, 3):
        want = [[" ".join(t[i : i + n]) for i in range(len(t) - n + 1)] for t in lists]
        assert by_id(df.select("id", tx.ngrams("tokens", n).alias("g")), "g") == want


def test_gram_rows_match_the_array_form(spark):
    lists = [[], ["a"], ["a", "b"], ["a", "b", "a", "b", "c"]]
    df = column(spark, lists, "tokens", "array<string>")
    rows = sorted((r.id, r.gram) for r in tx.token_gram_rows(df, ["id"]).collect())
    array = df.select("id", F.explode(tx.all_grams("tokens")).alias("gram"))
    assert rows == sorted((r.id, r.gram) for r in array.collect())


def test_raw_tokens_keep_case_and_punctuation(spark):
    texts = ["State-of-the-art, isn't it?", "3.5 MW", "", "«été»"]
    got = by_id(tx.with_raw_tokens(column(spark, texts), ["id"], "text"), "tokens")
    assert got == [
        ["State-of-the-art", ",", "isn't", "it", "?"],
        ["3", ".", "5", "MW"],
        [],
        ["«", "été", "»"],
    ]


def test_long_chains_and_words(spark):
    chain, word = "a-" * 200_000 + "a", "x" * 500_000
    got = by_id(tx.with_raw_tokens(column(spark, [chain, word]), ["id"], "text"), "tokens")
    assert got == [[chain], [word]]


def test_snippet_text_keeps_length_and_spaces(spark):
    texts = [" A,b\nC  9 "]
    assert by_id(column(spark, texts).select("id", tx.snippet_text("text").alias("s")), "s") == [" a b c    "]


def test_text_is_cleaned_once(spark, explain, tmp_path):
    column(spark, ["a b"]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    shown = explain(tx.gram_rows(df, ["id"], "text"))
    details = shown[shown.index("(1)") :]
    assert len(re.findall(r"regexp_replace", details)) <= 2  # once in the projection, shown once more as its output
    assert "size(array_remove" not in details
