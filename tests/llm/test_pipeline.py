import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gramlode.llm import simhash
from gramlode.session import stored

FOLDER = "/root/testdata/sf0.001"


def plain_survivors(rows):
    """Ids that stay of ``id, text``: the smallest of each group of fingerprints linked within the radius."""
    prints = [simhash.fingerprint((t or "").encode(), corpus_pipeline.SHINGLE) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= corpus_pipeline.BITS and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    order = lambda i: (i is None, i or 0)
    return sorted((min((r[0] for r, own in zip(rows, group) if own == g), key=order) for g in set(group)), key=order)


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, before, FOLDER), f"test-{name}")
        assert docs.columns == columns
        kept = [r.doc_id for r in docs.collect()]
        assert kept and set(kept) <= {r.doc_id for r in before.collect()}
        if name == "near_duplicates":
            assert sorted(kept) == plain_survivors([(r.doc_id, r.text) for r in before.collect()])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls everywhere, repeated ids and rows, empty and long texts, and columns named as the stages name
    their own."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kinds = docs.schema
    long = " ".join(r.text for r in docs.limit(60).collect())
    first = docs.orderBy("doc_id").first()
    rows = [(None, None, None, None, None), (None, "no id at all", "en", None, 12), (1, None, "xx", "src1", None), (2, "", None, None, 0)]
    rows += [(3, long, "en", "src2", None), tuple(first), tuple(first), (first.doc_id, "another text of the same id", "en", "src1", 27)]
    frame = docs.unionByName(spark.createDataFrame(rows, kinds))
    names = ["_score", "_label", "_row", "row", "doc", "fp", "root", "position", "size", "key", "words"]
    return stored(frame.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names))), "odd-docs")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_documents(spark, odd, name, stage):
    out = stage(spark, odd, FOLDER)
    rows = out.collect()
    if name == "encoding":
        assert len(rows) == odd.count()
        return
    assert out.columns == odd.columns
    given = {tuple(r) for r in odd.collect()}
    assert {tuple(r) for r in rows} <= given
    if name == "near_duplicates":
        order = lambda i: (i is None, i or 0)
        assert sorted((r.doc_id for r in rows), key=order) == plain_survivors([(r.doc_id, r.text) for r in odd.collect()])
    if name == "toxicity":  # no text, no evidence
        assert {r.doc_id for r in rows if not r.text} >= {1, 2, None}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_no_documents(spark, odd, name, stage):
    out = stage(spark, odd.where("false"), FOLDER)
    assert out.count() == 0 and (name == "encoding" or out.columns == odd.columns)
