"""Advert records from XML feeds.

Every reader returns the columns of ``ADVERT`` plus the record's key: ``source_file`` and ``record_no``. Several adverts
may share a JobID (it is ``'0'`` for all that have none), so later steps count per record and carry the id along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The record element and its children.
ROW_TAG = "Job"
FIELDS = ["JobID", "CanonJobTitle", "BGTOcc", "JobText"]

ADVERT = T.StructType([T.StructField(name, T.StringType()) for name in FIELDS])
CORRUPT = "_corrupt_record"
RECORD_KEY = ["source_file", "record_no"]
#: Archives of two years may have the same name.
ARCHIVE_KEY = ["year", *RECORD_KEY]


def _paths(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_xml(spark: SparkSession, paths: str | list[str], schema: T.StructType = ADVERT) -> DataFrame:
    """Row-tag scan of the ``*.xml`` files directly in one or more folders (or of the files named)."""
    return (
        spark.read.format("xml")
        .schema(schema)
        .option("rowTag", ROW_TAG)
        .option("ignoreSurroundingSpaces", "false")
        .option("pathGlobFilter", "*.xml")
        .load(_paths(paths))
    )


def infer_xml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same scan with the schema inferred, one row per field found."""
    found = (
        spark.read.format("xml").option("rowTag", ROW_TAG).option("pathGlobFilter", "*.xml").load(_paths(paths)).schema
    )
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in found]
    return spark.range(1).select(F.inline(F.array(*rows)))


def parse_records(df: DataFrame, record: str = "job_xml", keep: list[str] | None = None) -> DataFrame:
    """Advert fields out of one XML record per row.

    A malformed record keeps its row, with null fields and its text in ``_corrupt_record``.
    """
    keep = RECORD_KEY if keep is None else keep
    schema = T.StructType([*ADVERT.fields, T.StructField(CORRUPT, T.StringType())])
    options = {
        "rowTag": ROW_TAG,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "ignoreSurroundingSpaces": "false",
    }
    # unfolded by a generator, which filters on the fields cannot be pushed through: each record is parsed once
    return df.select(*keep, F.inline_outer(F.array(F.from_xml(record, schema.simpleString(), options))))


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_framed_xml(spark: SparkSession, paths: str | list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Advert records from ``*.xml`` files, cut at the closing tag by the text source.

    Unlike the row-tag reader this splits large files, takes the charsets that Spark's `decode` knows and keeps a bad record
    to itself.
    A record starts at the last opening tag before its closing tag, with or without attributes; text in front of a
    record is ignored. A record without closing tag at the end of a file, or with a broken opening tag, is malformed.
    """
    closing = f"</{ROW_TAG}>"
    opens = rf"<{ROW_TAG}[\s>]"
    record = rf"(?s)^.*(<{ROW_TAG}(?:\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)?>.*)$"
    raw = spark.read.option("lineSep", closing).option("pathGlobFilter", "*.xml").text(_paths(paths))
    # the text source hands over the bytes as they are, which is right for UTF-8 only
    unicode = encoding.upper().replace("-", "") == "UTF8"
    text = F.col("value") if unicode else F.decode(F.col("value").cast("binary"), encoding)
    framed = raw.where(F.col("value").rlike(opens)).select(
        file_name().alias("source_file"),
        # taken directly on the scan, whose splits are fixed for the run: a recomputed task numbers its rows alike
        F.monotonically_increasing_id().alias("record_no"),
        text.alias("piece"),
    )
    found = framed.select(*RECORD_KEY, F.array("piece", F.regexp_extract("piece", record, 1)).alias("found"))
    whole = F.when(F.col("found")[1] == "", F.col("found")[0]).otherwise(F.col("found")[1])
    return parse_records(found.select(*RECORD_KEY, F.concat(whole, F.lit(closing)).alias("job_xml")))


def rejected(parsed: DataFrame) -> DataFrame:
    """The records that could not be parsed."""
    return parsed.where(F.col(CORRUPT).isNotNull())


def usable(parsed: DataFrame) -> DataFrame:
    """The adverts that can be counted: text not empty, occupation and title tags present (they may be empty).

    A missing or empty id becomes ``'0'``. A malformed record has no fields and falls out as well.
    """
    kept = parsed.where((F.col("JobText") != "") & F.col("BGTOcc").isNotNull() & F.col("CanonJobTitle").isNotNull())
    job_id = F.when(F.coalesce("JobID", F.lit("")) == "", F.lit("0")).otherwise(F.col("JobID"))
    return kept.withColumn("JobID", job_id).drop(CORRUPT)


def tally(parsed: DataFrame, *by: str) -> DataFrame:
    """Processed and rejected records per archive."""
    by = by or ("source_file",)
    bad = F.col(CORRUPT).isNotNull()
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(bad).alias("rejected"),
    )
