"""Plain tables and lists: text lines, label lists, keyword sheets, year folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw lines of text files at any path Spark can read."""
    return spark.read.text(paths)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, label)``: candidate labels, one per line, with the file's name and the line's number from 0; blank
    lines are dropped. Label files are short lists and read whole, which keeps the order of their lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "label"))
    return lines.where(F.trim("label") != "")


def read_keyword_sheets(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """``(tech, tech_pos, raw)`` from CSV sheets below ``tech=<name>/`` with a column ``bigrams``.

    ``tech_pos`` is the place of the sheet in ``order``; sheets not named there come first.
    """
    sheets = spark.read.option("header", "true").schema("bigrams string, tech string").csv(path)
    position = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tech")) if order else F.lit(0)
    return sheets.select("tech", position.cast("int").alias("tech_pos"), F.col("bigrams").alias("raw")).where(
        F.col("raw").isNotNull()
    )


def in_years(start: int, end: int, skip: list[int] | tuple[int, ...] = (), column: str = "year") -> Column:
    """Years ``start`` to ``end`` without those in ``skip``, as one condition that prunes year partitions."""
    chosen = F.col(column).between(start, end)
    return chosen & ~F.col(column).isin(list(skip)) if skip else chosen
