"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.llm import alignment, bpe, fingerprint, html, lm, mixing, negatives, quality, secrets, simhash, topk, toxicity, warc
from gramlode.llm.common import held_out, table
from gramlode.llm.oracles import ORACLES  # noqa: F401 - registered with the queries
from gramlode.session import stored


def op1_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lm.score(docs, held_out(F.col("doc_id"), 7, 2)).withColumnRenamed("key", "doc_id")


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    prints = stored(simhash.fingerprints(table(spark, folder, "documents")), "simhash")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return simhash.grouped(prints).select("doc_id", hexed, "component_id")


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, folder, "documents"))


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0")).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score"
    )


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    out = html.extract(table(spark, folder, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    out = fingerprint.versions(table(spark, folder, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.md5("sketch").alias("fingerprint"),
        F.md5("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(spark, table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    first, last = F.get("positions", F.lit(0)), F.try_element_at("positions", F.lit(-1))
    return mixed.select(
        "doc.doc_id", "size", "source_size", "target", "taken",
        F.round(first, 9).alias("first_position"), F.round(last, 9).alias("last_position"),
    )


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = held_out(F.col("doc_id"), 5, 0)
    machine = quality.fit(docs, table(spark, folder, "labels"), "quality", ~held)
    return quality.score(docs, machine, ["doc_id"]).select(
        "doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted")
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~held)
    flagged = F.col("_score") >= toxicity.threshold(model, F.col("lang"))
    return toxicity.score(docs, model, ["doc_id", "lang"]).select(
        "doc_id",
        held.alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        flagged.alias("flagged"),
    )


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, folder, "embeddings").withColumn("label", changed))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.linked_corpus(table(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[: secrets.BASE]))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    return found.select(
        F.col("key").alias("doc_id"),
        *(number(kind) for kind in secrets.KINDS[: secrets.BASE]),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


QUERIES = {
    "op1_lm": op1_lm,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_topk": op4_topk,
    "op5_html": op5_html,
    "op6_fingerprint": op6_fingerprint,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_negatives": op11_negatives,
    "op12_alignment": op12_alignment,
    "op13_secrets": op13_secrets,
}
