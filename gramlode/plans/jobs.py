"""Whole jobs made of the steps, from files to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.operators import bigrams, counting, dictionary, labels, pages
from gramlode.session import stored
from gramlode.sinks import files as sink
from gramlode.sinks import versions
from gramlode.sources import adverts, archives
from gramlode.sources import tables as src


def ingest_archives(
    spark: SparkSession,
    feed: str,
    table: str,
    start_year: int,
    end_year: int,
    skip: Sequence[int] = (),
    encoding: str = "ISO-8859-1",
    undated: str = "error",
) -> DataFrame:
    """Unpack and parse the archives of the chosen years once, into the versioned table ``table``, by year and archive.

    Everything later reads that table (``versions.read``): columns are pruned, and no archive is unpacked twice. Malformed
    records are kept with their text in ``_corrupt_record``. Running an archive again replaces its rows, also when no
    record is left; readers see all of a run or nothing. An archive without a year in its path is an error, or with
    ``undated="leave"`` left out (``archives.left_out`` lists those). Returns the stored list of archives,
    ``(year, source_file)``.
    """
    years = [y for y in range(start_year, end_year + 1) if y not in set(skip)]
    listing = archives.list_archives(spark, feed, years, undated)
    listed = stored(listing.select("year", "source_file"), "archives")
    if not listed.isEmpty():
        versions.replace(archives.read_archives(spark, feed, years, encoding, undated), table, listed)
    return listed


def ingest_new_archives(spark: SparkSession, feed: str, table: str, state: str, encoding: str = "ISO-8859-1") -> None:
    """Ingest the archives that came into ``feed`` since the last call with the same ``state`` folder, then return.

    A file stream remembers which archives it has seen. Each of its batches is published as one version named after the
    batch, so a batch that is repeated after a failure replaces itself. Archives without a year in their path fail the
    batch. An archive that is written anew under its old name counts as seen; ingest its year to replace it.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    listing = files.option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(feed).select("path")

    def ingest(batch: DataFrame, number: int) -> None:
        listed = stored(archives.named(batch, feed), "new-archives")
        undated = [row.path for row in listed.where(F.col("year").isNull()).limit(5).collect()]
        if undated:
            raise ValueError(f"no year in the paths of {', '.join(undated)}")
        if not listed.isEmpty():
            parsed = archives.unpack_listed(listed, encoding)
            versions.replace(parsed, table, listed.select("year", "source_file"), f"batch-{number:09d}")

    writer = listing.writeStream.foreachBatch(ingest).option("checkpointLocation", state).trigger(availableNow=True)
    writer.start().awaitTermination()


def ingest_tally(spark: SparkSession, table: str) -> DataFrame:
    """Processed and rejected records per year and archive."""
    return adverts.tally(versions.read(spark, table), "year", "source_file")


def build_dictionary(
    spark: SparkSession, sheets: DataFrame, inflect: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keywords, surface forms and matcher, stored in the scratch folder."""
    keywords = stored(dictionary.keyword_dict(sheets), "keywords")
    surfaces = stored(dictionary.surface_dict(keywords, inflect), "surfaces")
    return keywords, surfaces, stored(dictionary.matcher(surfaces, keywords), "matches")


def count_adverts(
    spark: SparkSession,
    table: str,
    sheets: DataFrame,
    out: str,
    listed: DataFrame,
    inflect: bool = True,
    snippet_share: float = 0.001,
) -> None:
    """Count files and snippet files of an ingested feed.

    Below ``out``: ``counts/tech=…/year=…/source_file=…`` with one column per base word, ``snippets/tech=…/year=…/source_file=…``.
    ``listed``: the ``(year, source_file)`` to count, as the ingest returns them.
    The long counts are stored once; all technologies' wide files are one write of ready lines.
    """
    keywords, _, matches = build_dictionary(spark, sheets, inflect)
    usable = adverts.usable(versions.read(spark, table)).join(listed, listed.columns, "left_semi")
    renamed = usable.withColumn("source_file", sink.output_name("source_file"))
    outputs = listed.withColumn("source_file", sink.output_name("source_file"))
    key = adverts.ARCHIVE_KEY

    long = stored(counting.keyword_counts(renamed, matches, key, "JobText", carry=["JobID"]), "counts")
    lines = counting.count_lines(long, keywords, key, ["year", "source_file"], "JobID")
    sink.write_count_lines(lines, out, archives=outputs)
    found = counting.snippets(renamed, matches, key, "JobText", "JobID", "CanonJobTitle", "BGTOcc", p=snippet_share)
    sink.write_snippets(found.drop("record_no"), out, archives=outputs)


def explore_synonyms(
    spark: SparkSession,
    feed: str | list[str],
    counts_path: str,
    base: str,
    core: str,
    threshold: float = 0.7,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Count all bigrams of an XML feed into ``counts_path``, then list the candidates for ``base`` from that table.

    The feed is read in splits, so one large file is no bottleneck. Later look-ups for other words need only
    ``bigrams.synonym_candidates`` on the table.
    """
    texts = adverts.read_framed_xml(spark, feed, encoding).select("JobText")
    sink.write_bigram_counts(bigrams.bigram_counts(texts, "JobText"), counts_path)
    counts = spark.read.parquet(counts_path)
    return bigrams.most_frequent_first(bigrams.synonym_candidates(counts, base, core, threshold))


def rank_labels(
    spark: SparkSession,
    docs: DataFrame,
    labels_path: str,
    key: list[str],
    text: str,
    scorer: labels.Scorer = labels.word_rate,
) -> DataFrame:
    """Candidate labels from a text file, ranked for every document; equal scores rank in the order of the lines. The
    labels become part of the plan."""
    names = [row.label for row in src.read_labels(spark, labels_path).orderBy("file", "pos").collect()]
    return labels.label_scores(docs, names, key, text, scorer)


def answer_requests(
    requests: DataFrame,
    captured: DataFrame,
    key: str,
    payload: str,
    tag: str,
    attr: str,
    value: str,
    url_prefix: str = "",
) -> DataFrame:
    """One JSON body per request, from captured pages."""
    symbols = pages.request_symbols(requests, key, payload, url_prefix)
    return pages.json_bodies(pages.answers(symbols, pages.page_values(captured, tag, attr, value)), key)
