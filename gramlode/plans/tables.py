"""The given tables, and the inputs that Spark derives from them."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.functions.text import token_gram_rows, with_clean_tokens
from gramlode.operators import dictionary
from gramlode.session import scratch_path, spread, spread_by_size, stored
from gramlode.sources.archives import make_folder, open_stream

# A small keyword workbook with a hit in every branch.
SHEETS = {
    "english": ["of_the", "the_and2", "that", "the the"],
    "romance": ["de_la", "eux"],
    "shared": ["that", "is"],
    "german": ["der_die", "und die zu"],
}

# Candidate labels.
LABELS = [
    "biodegradable and compostable materials",
    "greenhouse gas capture",
    "combustion technologies",
    "efficient electrical power generation",
    "emissions reductions in production",
    "end-user energy management",
    "energy efficient solutions",
    "fuels of non-fossil origin",
    "improved thermal performance",
    "new energy vehicles",
    "nuclear",
    "renewable energy",
    "smart grids",
    "waste management",
]

# Labels whose words occur in the given texts, so that scores differ between documents.
FREQUENT_LABELS = ["of the", "that is", "de la", "der die und", "con los", "thermal energy"]

ARCHIVE_DOCS = 200
FIRST_YEAR = 2010
YEAR_FOLDERS = 3
ROLES = ["assistant", "system", "user"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The wanted document columns, spread by document when the file is small."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


_dictionaries: dict[tuple[str, bool], tuple[DataFrame, DataFrame, DataFrame]] = {}


def literal_dictionary(spark: SparkSession, inflect: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keywords, surfaces and matcher of the small workbook.

    Like any dimension they are stored tables, written once per application: the planner then knows their size, and the
    size check does not work them out again.
    """
    made = (spark.sparkContext.applicationId, inflect)
    if made not in _dictionaries:
        sheets = dictionary.literal_sheets(spark, SHEETS)
        keywords = stored(dictionary.keyword_dict(sheets).coalesce(1), "keywords")
        surfaces = stored(dictionary.surface_dict(keywords, inflect).coalesce(1), "surfaces")
        matches = stored(dictionary.matcher(surfaces, keywords).coalesce(1), "matches")
        _dictionaries[made] = (keywords, surfaces, matches)
    return _dictionaries[made]


def derived_sheets(spark: SparkSession, sf_dir: str, by_size: bool = False) -> DataFrame:
    """A workbook that grows with the data: every word and bigram of the conversations is a raw keyword of its role.

    ``by_size`` bounds the text of a task, for steps that hold all its keywords."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = spread_by_size(turns, "text", "conv_id", "turn") if by_size else spread(turns, "conv_id", "turn")
    grams = token_gram_rows(with_clean_tokens(turns, ["role"], "text"), ["role"])
    raw = F.concat(F.translate("gram", " ", "_"), F.pmod(F.length("gram"), F.lit(10)).cast("string"))
    position = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int")
    return grams.select(F.col("role").alias("tech"), position.alias("tech_pos"), raw.alias("raw"))


def archive_number() -> Column:
    return F.floor(F.col("doc_id") / ARCHIVE_DOCS)


def archive_name(share: int = 1) -> Column:
    return F.format_string("US_%05d.zip", F.floor(archive_number() / share))


def archive_year() -> Column:
    return F.lit(FIRST_YEAR) + F.pmod(archive_number(), F.lit(YEAR_FOLDERS)).cast("int")


def advert_fields() -> list[Column]:
    """Documents in the place of adverts."""
    return [
        F.col("doc_id").cast("string").alias("JobID"),
        F.col("lang").alias("CanonJobTitle"),
        F.col("source").alias("BGTOcc"),
        F.col("text").alias("JobText"),
    ]


def write_xml_feed(spark: SparkSession, sf_dir: str, attributes: bool = False) -> str:
    """All documents as XML adverts in the scratch folder; with ``attributes`` every other record's tag has one."""
    path = scratch_path(spark, "xml_feed")
    docs = documents(spark, sf_dir, "lang", "source", "text").select(
        *([F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a>"), F.col("doc_id"))).alias("_ref")] if attributes else []),
        *advert_fields(),
    )
    docs.write.format("xml").option("rootTag", "Jobs").option("rowTag", "Job").save(path)
    return path


def write_zip_feed(
    spark: SparkSession,
    sf_dir: str,
    broken: Column | None = None,
    plain: bool = False,
    path: str | None = None,
    chosen: Column | None = None,
    blank: Column | None = None,
    name: Column | None = None,
) -> str:
    """All documents as XML adverts in zip archives of ``ARCHIVE_DOCS`` records below ``year=`` folders.

    Where ``broken`` holds, the record loses its text's closing tag, where ``blank`` holds it is left out, though not its
    archive. With ``plain`` the folders are named by the year alone, and each has archives of the same names; ``name`` gives
    the archives other paths. ``chosen`` documents only, into ``path``. Each archive is streamed out by one task.
    """
    path = path or scratch_path(spark, "zip_feed")
    docs = documents(spark, sf_dir, "lang", "source", "text")
    docs = docs if chosen is None else docs.where(chosen)
    record = F.to_xml(F.struct(*advert_fields()), {"rowTag": "Job"})
    if broken is not None:
        record = F.when(broken, F.replace(record, F.lit("</JobText>"), F.lit(""))).otherwise(record)
    if blank is not None:
        record = F.when(~blank, record).otherwise("")
    if name is None:
        prefix, file = ("", archive_name(YEAR_FOLDERS)) if plain else ("year=", archive_name())
        name = F.concat(F.lit(prefix), archive_year(), F.lit("/"), file)
    rows = docs.select("doc_id", name.alias("name"), record.alias("xml"))
    placed = rows.repartition("name").sortWithinPartitions("name", "doc_id")
    placed.select("name", "xml").mapInArrow(_archive_writer(path), "name string").count()
    return path


def _archive_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stack, member = None, None, None

        def close() -> None:
            member.write(b"</Jobs>\n")
            for handle in reversed(stack):
                handle.close()
            _publish(f"{folder}/{name}.{suffix}", f"{folder}/{name}")

        suffix = uuid.uuid4().hex  # attempts of one task do not meet in one file
        for batch in batches:
            for of, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != name:
                    if name is not None:
                        close()
                    name = of
                    make_folder(f"{folder}/{name}".rsplit("/", 1)[0])
                    raw = open_stream(f"{folder}/{name}.{suffix}", "w")
                    archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                    member = archive.open(name.rsplit("/", 1)[-1][:-4] + ".xml", "w", force_zip64=True)
                    stack = [raw, archive, member]
                    member.write(b"<?xml version='1.0' encoding='ISO-8859-1'?>\n<Jobs>\n")
                member.write(xml.encode("latin-1", "xmlcharrefreplace") + b"\n")
        if name is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], names=["name"])

    return write


def _publish(written: str, final: str) -> None:
    from pyarrow import fs

    if written.startswith("file:"):
        written, final = ("/" + p[len("file:") :].lstrip("/") for p in (written, final))
    if written.startswith("/"):
        fs.LocalFileSystem().move(written, final)
    else:
        system, source = fs.FileSystem.from_uri(written)
        system.move(source, fs.FileSystem.from_uri(final)[1])
