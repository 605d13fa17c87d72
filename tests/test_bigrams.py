from collections import Counter

from gramlode.operators import bigrams


def counts(spark, pairs):
    return spark.createDataFrame(pairs, "bigram string, count bigint")


def test_counts_and_order(spark):
    docs = spark.createDataFrame([("Clean energy, clean energy",), ("clean energy",), ("one",), ("",)], "text string")
    got = bigrams.bigram_counts(docs, "text")
    assert Counter({r.bigram: r["count"] for r in got.collect()}) == Counter(
        {"clean energy": 2, "Clean energy": 1, "energy ,": 1, ", clean": 1}
    )
    assert [r.bigram for r in bigrams.most_frequent_first(got).collect()] == [
        "clean energy",
        ", clean",
        "Clean energy",
        "energy ,",
    ]


def test_top_k_does_not_sort_everything(spark, explain):
    assert "TakeOrderedAndProject" in explain(bigrams.most_frequent_first(counts(spark, [("a b", 1)])).limit(3))


def test_band_is_strict_in_doubles(spark):
    table = counts(spark, [("base x", 10), ("low x", 3), ("in x", 4), ("in y", 16), ("high x", 17)])
    band = bigrams.frequency_band(table, "base x", 0.7)
    # 10 * (1 - 0.7) is a little above 3 and 10 * 1.7 is 17
    assert sorted(r.bigram for r in band.collect()) == ["base x", "in x", "in y"]
    found = bigrams.synonym_candidates(table, "base x", "x", 0.7)
    assert sorted(r.bigram for r in found.collect()) == ["base x", "in x"]


def test_absent_base_gives_nothing(spark):
    assert bigrams.frequency_band(counts(spark, [("a b", 1)]), "c d").count() == 0


def test_band_needs_no_cross_join(spark, explain, tmp_path):
    from gramlode.sinks.files import write_bigram_counts

    write_bigram_counts(counts(spark, [("a b", 5), ("b c", 4)]), str(tmp_path / "c"))
    table = spark.read.parquet(str(tmp_path / "c"))
    shown = explain(bigrams.synonym_candidates(table, "a b", "b"))
    assert "NestedLoop" not in shown and "Cartesian" not in shown
    assert "EqualTo(bigram,a b)" in shown
