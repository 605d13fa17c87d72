"""The keyword dictionary: from raw sheets to the surface forms looked up in the text."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.functions.inflect import IRREGULAR, SHORT_WORD, other_number, singular


def literal_sheets(spark: SparkSession, sheets: Mapping[str, list[str]]) -> DataFrame:
    """``(tech, tech_pos, raw)`` from lists in the program; later sheets have the larger position."""
    rows = [(tech, i, raw) for i, (tech, words) in enumerate(sheets.items(), start=1) for raw in words]
    techs, positions, raws = (list(c) for c in zip(*rows))
    table = pa.table({"tech": techs, "tech_pos": pa.array(positions, pa.int32()), "raw": raws})
    return spark.createDataFrame(table)


def normalise(raw: Column | str) -> Column:
    """Underscores become spaces, digits go; case and outer spaces stay."""
    return F.translate(raw, "_0123456789", " ")


def keyword_dict(sheets: DataFrame) -> DataFrame:
    """Distinct base words per technology: ``(tech, base)``, with ``tech_pos`` when the sheets have it."""
    order = [c for c in ("tech_pos",) if c in sheets.columns]
    return sheets.select("tech", *order, normalise("raw").alias("base")).distinct()


def dict_size(keywords: DataFrame) -> DataFrame:
    """Number of base words per technology."""
    return keywords.groupBy("tech").agg(F.count_distinct("base").alias("n_words"))


def with_forms(bases: DataFrame, inflect: bool = True, irregular: Mapping[str, str] = IRREGULAR) -> DataFrame:
    """``(…, base, surface)``: every form under which a base word is looked up.

    Up to five characters: the word itself. One word: itself and its other number. More words: the first two, each in
    both numbers; any further word is not looked at. Without ``inflect`` only the short words are looked up.
    """
    keep = bases.columns
    if not inflect:
        return bases.where(F.length("base") <= SHORT_WORD).withColumn("surface", F.col("base"))
    # one projection per step, so that no expression is repeated inside the next
    short = F.length("base") <= SHORT_WORD
    words = bases.select(*keep, F.split("base", " ").alias("_w"), F.regexp_count("base", F.lit(r"\S+")).alias("_n"))
    single = F.col("_n") == 1
    parts = words.select(
        *keep,
        "_n",
        # a single word is flipped with any outer spaces it has
        F.when(single, F.col("base")).otherwise(F.get("_w", F.lit(0))).alias("_a"),
        F.when(~single, F.coalesce(F.get("_w", F.lit(1)), F.lit(""))).alias("_b"),
    )
    ones = parts.select(*keep, "_n", "_a", "_b", singular("_a").alias("_sa"), singular("_b").alias("_sb"))
    flipped = ones.select(
        *keep,
        "_n",
        "_a",
        "_b",
        other_number("_a", "_sa", irregular).alias("_fa"),
        other_number("_b", "_sb", irregular).alias("_fb"),
    )
    pairs = [F.concat(F.col(a), F.lit(" "), F.col(b)) for a in ("_a", "_fa") for b in ("_b", "_fb")]
    forms = F.when(short, F.array("base")).when(single, F.array("_a", "_fa")).otherwise(F.array(*pairs))
    return flipped.select(*keep, F.explode_outer(F.array_distinct(forms)).alias("surface"))


def surface_dict(keywords: DataFrame, inflect: bool = True, irregular: Mapping[str, str] = IRREGULAR) -> DataFrame:
    """``(surface, base)``, one base word per surface form.

    When two base words share a form, the one from the last sheet wins; within a sheet, or without sheet positions, the
    one that sorts last.
    """
    order = ["tech_pos"] if "tech_pos" in keywords.columns else []
    # forms depend on the base word only: made once per base word, at its last sheet
    last = [F.max("tech_pos").alias("tech_pos")] if order else []
    bases = keywords.groupBy("base").agg(*last) if last else keywords.select("base").distinct()
    forms = with_forms(bases, inflect, irregular)
    winner = F.max(F.struct(*order, "base"))["base"]
    return forms.groupBy("surface").agg(winner.alias("base"))


def matcher(surfaces: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(surface, base, tech)``: both dictionary look-ups in one table, so the text is joined once."""
    return surfaces.join(keywords.select("base", "tech"), "base").select("surface", "base", "tech")
