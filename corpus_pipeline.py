"""The corpus pipeline: stages that each take the documents their predecessor kept.

A stage is called with the session, the documents and the folder of the given tables. All but the last return the columns
of the documents; the last one returns the encoded documents. Whatever the columns are called, a stage works beside them:
the row travels in a struct. No documents give no documents, at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.llm import bpe, mixing, quality, simhash, toxicity
from gramlode.llm.common import held_out, table
from gramlode.session import scratch_path

#: The lowest quality score that stays.
LEAST_QUALITY = 0.3
#: Near-duplicates: words of a shingle, and bits in which two linked fingerprints differ at most.
SHINGLE, BITS = 4, 4


def _inputs(docs: DataFrame) -> DataFrame:
    """The columns that the classifiers read, and the whole row as a struct."""
    columns = ("doc_id", "text", "lang", "n_chars")
    return docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that do not reach their language's threshold of toxicity.

    A null or empty text has the lowest evidence and stays; a null language has the threshold of one half; repeated rows
    are scored alike. A score right at the threshold goes.
    """
    rows = _inputs(docs)
    model = toxicity.fit(rows.drop("doc"), table(spark, folder, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    scored = toxicity.score(rows, model, ["doc", "lang"])
    return scored.where(F.col("_score") < toxicity.threshold(model, F.col("lang"))).select("doc.*")


def drop_poor(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of sufficient quality. A null or empty text is scored by its statistics alone, a missing length counts as
    the text's own; repeated rows are scored alike. A score right at the limit stays."""
    rows = _inputs(docs)
    machine = quality.fit(rows.drop("doc"), table(spark, folder, "labels"), "quality", ~held_out(F.col("doc_id"), 5, 0))
    return quality.score(rows, machine, ["doc"]).where(F.col("_score") >= LEAST_QUALITY).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, null last. Null, empty and blank texts
    are linked like any others, and equal rows are one document."""
    return simhash.one_of_each(docs, words=SHINGLE, radius=BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents in training order, each as often as the mix of sources takes it. Texts without words are never taken;
    a null source is a source of its own; rows without id are ordered by their text, and equal rows stand together."""
    return mixing.curriculum(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids and digests of every document; a null or empty text has no tokens. Rows stay as they are, repeated ones
    and those without id too."""
    return bpe.encoded_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: Trained models and fingerprints cannot be written in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
