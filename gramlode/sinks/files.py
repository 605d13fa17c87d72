"""Count and snippet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.session import stored

#: Tasks move their files to the job's own folder when they end, side by side. The program would otherwise move every file
#: of the job, one after another, before the job's folder takes its place.
COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def write_new_parquet(df: DataFrame, path: str) -> None:
    """Parquet; fails when the target is there already."""
    df.write.mode("errorifexists").parquet(path)


def write_bigram_counts(counts: DataFrame, path: str) -> None:
    """The count table as it is queried later: in ranges of counts, so that a band of counts reads few files and row
    groups, and with a bloom filter on the bigram for single look-ups. Most bigrams have the same few counts; the bigram is
    part of the range, so that they are spread over many files too. Within a range rows are sorted by count alone."""
    (
        counts.repartitionByRange("count", "bigram")
        .sortWithinPartitions("count")
        .write.mode("errorifexists")
        .option("parquet.bloom.filter.enabled#bigram", "true")
        .parquet(path)
    )


def output_name(source_file: Column | str) -> Column:
    """Name of an archive's output: each ``zip`` with the character in front of it becomes ``.csv``."""
    return F.regexp_replace(source_file, ".zip", ".csv")


def exists(spark: SparkSession, path: str) -> bool:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def _files(spark: SparkSession, path: str, archives: DataFrame) -> DataFrame | None:
    """``(path)`` of the files below ``path`` in partitions of the listed archives; None when there is none. Only names
    are listed."""
    if not exists(spark, path):
        return None
    found = spark.read.format("binaryFile").load(path)
    if not set(archives.columns) <= set(found.columns):
        return None
    as_text = [F.col(c).cast("string").alias(c) for c in archives.columns]
    return found.select("path", *as_text).join(archives.select(*as_text), archives.columns, "left_semi").select("path")


def replace_archives(
    df: DataFrame,
    path: str,
    partitions: list[str],
    archives: DataFrame | None,
    form: str = "parquet",
    placed: bool = False,
    **options: str,
) -> None:
    """Write ``df`` below ``path``, replacing what an earlier run wrote for the same archives.

    ``archives`` has a row for every archive of this run, its columns are among ``partitions``. Partitions with new rows
    are overwritten; the old files that are still there afterwards belong to archives without rows this time, and go
    last, so that a failed write loses nothing. Rebalancing on the partition columns gives few files per archive, and
    splits an archive that is much larger than the others over several tasks; rows that are ``placed`` already stay.
    """
    spark = df.sparkSession
    before = None if archives is None else _files(spark, path, archives)
    if before is not None:
        before = stored(before, "old-files")
    (
        (df if placed else df.hint("rebalance", *[F.col(c) for c in partitions]))
        .write.mode("overwrite")
        .format(form)
        .option("partitionOverwriteMode", "dynamic")
        .options(**COMMIT, **options)
        .partitionBy(*partitions)
        .save(path)
    )
    if before is None:
        return
    left = _files(spark, path, archives)
    if left is None:
        return
    parent = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    stale = left.join(before, "path", "left_semi").select(parent).distinct()
    jvm = spark.sparkContext._jvm
    for row in stale.toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(row.folder)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def folder_name(spark: SparkSession, name: str) -> str:
    """``name`` as one level of a path."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def _by_archive(df: DataFrame) -> list[str]:
    return [c for c in ("tech", "year", "source_file") if c in df.columns]


def write_wide_counts(wide: DataFrame, path: str, tech: str, archives: DataFrame | None = None) -> None:
    """One folder per technology, one partition per archive (below its year, if ``wide`` has one):
    ``job_id|word|word|…``, blank where there was no hit. Files of technologies that left the dictionary stay."""
    to = f"{path}/counts/{folder_name(wide.sparkSession, tech)}"
    replace_archives(wide, to, _by_archive(wide), archives, "csv", sep="|", header="true")


def write_count_lines(lines: DataFrame, path: str, archives: DataFrame | None = None) -> None:
    """``counting.count_lines`` of all technologies by one write: one file per technology and archive, its header first.

    The time goes by the number of files and not by their bytes, so the files are dealt over all cores in tasks that are not
    put together for being small."""
    by = _by_archive(lines)
    cores = lines.sparkSession.sparkContext.defaultParallelism
    placed = lines.repartition(cores, *by).sortWithinPartitions(*by, "part").select(*by, "line")
    replace_archives(placed, f"{path}/counts", by, archives, "text", placed=True)


def write_snippets(snippets: DataFrame, path: str, archives: DataFrame | None = None) -> None:
    """``job_id,keyword,job_title,occupation,jobtext``, quoted where needed, per technology and archive."""
    spaces = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}  # they are part of the text
    to = f"{path}/snippets"
    replace_archives(snippets, to, _by_archive(snippets), archives, "csv", header="true", escape='"', **spaces)
