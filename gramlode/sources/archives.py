"""Advert records out of zip archives, one XML member each.

A data source plans the tasks: archives of the wanted years, put together to about the same size. Each task streams its
members through a small buffer, so neither an archive nor its member is ever held whole. A zip member cannot be split.
The records are therefore spread again by their key before the parsing and counting, which is the larger part of the
work: one archive that holds a third of all adverts keeps one task busy with unpacking only.

An archive's year is the folder nearest to it that is named ``year=2014`` or ``2014``, at any depth. Its name is its path
below that folder, so that two folders of a year may hold archives of the same name.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gramlode.sources.adverts import ARCHIVE_KEY, ROW_TAG, parse_records

CHUNK = 1 << 20
BATCH_BYTES = 4 << 20
#: Bytes of archives that a task unpacks, and archives at most; one archive may be larger.
TASK_BYTES, TASK_ARCHIVES = 128 << 20, 1000
#: The year's folder and the name below it, in the path below the feed's folder; without a year all of that is the name.
DATED = r"^/(?:.*/)?(?:year=)?([0-9]{4})/(.*)$"
RECORDS = "year int, source_file string, record_no bigint, job_xml string"


def _located(path: str):
    """File system and path of a local path or a storage URI, by Arrow."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    for hadoop_scheme in ("s3a://", "s3n://"):
        if path.startswith(hadoop_scheme):
            path = "s3://" + path[len(hadoop_scheme) :]
    return fs.FileSystem.from_uri(path)


def open_stream(path: str, mode: str = "r"):
    """An Arrow file handle for a local path or a storage URI."""
    system, path = _located(path)
    return system.open_input_file(path) if mode == "r" else system.open_output_stream(path)


def make_folder(path: str) -> None:
    """A folder and those above it; nothing happens when it is there."""
    system, path = _located(path)
    system.create_dir(path, recursive=True)


def frame(chunks: Iterable[bytes], row_tag: str = ROW_TAG) -> Iterator[bytes]:
    """Cut a byte stream into records: from the last opening tag before a closing tag through that closing tag."""
    opening, closing = f"<{row_tag}>".encode(), f"</{row_tag}>".encode()
    rest = b""
    for chunk in chunks:
        searched = max(len(rest) - len(closing), 0)
        rest += chunk
        done = 0
        while (end := rest.find(closing, max(searched, done))) >= 0:
            stop = end + len(closing)
            start = rest.rfind(opening, done, end)
            if start >= 0:
                yield rest[start:stop]
            done = stop
        # what stands before the last opening tag belongs to no record; without one, a tag may be cut at the end
        last = rest.rfind(opening, done)
        rest = rest[last if last >= 0 else max(done, len(rest) - len(closing)) :]


def _only_member(archive: zipfile.ZipFile, path: str) -> str:
    names = archive.namelist()
    if len(names) != 1:
        raise ValueError(f"{path}: expected one member, found {len(names)}")
    return names[0]


def _records(path: str, encoding: str) -> Iterator[str]:
    with open_stream(path) as raw, zipfile.ZipFile(raw) as archive:
        with archive.open(_only_member(archive, path)) as member:
            for record in frame(iter(lambda: member.read(CHUNK), b"")):
                yield record.decode(encoding)


def unpacked(path: str, year: int | None, name: str, encoding: str) -> Iterator[pa.RecordBatch]:
    """The records of one archive, a few megabytes at a time."""
    texts: list[str] = []
    size, number = 0, 0
    for text in _records(path, encoding):
        texts.append(text)
        size += len(text)
        if size >= BATCH_BYTES:
            yield _batch(year, name, number, texts)
            number += len(texts)
            texts, size = [], 0
    if texts:
        yield _batch(year, name, number, texts)


def _batch(year: int | None, name: str, first: int, texts: list[str]) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([year] * n, pa.int32()),
            pa.array([name] * n, pa.string()),
            pa.array(range(first, first + n), pa.int64()),
            pa.array(texts, pa.string()),
        ],
        names=["year", "source_file", "record_no", "job_xml"],
    )


@dataclass
class ArchiveTask(InputPartition):
    """Archives that one task unpacks: path, year and name."""

    archives: list[tuple[str, int | None, str]]


def planned(found: Iterable[tuple[str, int | None, str, int]]) -> list[ArchiveTask]:
    """Tasks for archives given by path, year, name and bytes: the largest first, each into the task with room, so that tasks
    take about the same time."""
    tasks: list[ArchiveTask] = []
    room = 0
    for path, year, name, size in sorted(found, key=lambda a: (-a[3], a[0])):
        if not tasks or size > room or len(tasks[-1].archives) >= TASK_ARCHIVES:
            tasks.append(ArchiveTask([]))
            room = TASK_BYTES
        tasks[-1].archives.append((path, year, name))
        room -= size
    return tasks


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        self.years = {int(y) for y in options["years"].split(",") if y} if "years" in options else None
        self.undated = options.get("undated", "error")
        self.encoding = options.get("encoding", "ISO-8859-1")

    def partitions(self) -> list[ArchiveTask]:
        from pyarrow import fs

        system, folder = _located(self.folder)
        below = self.folder[: len(self.folder) - len(folder)] if self.folder.endswith(folder) else ""
        chosen, undated = [], []
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True)):
            if info.type != fs.FileType.File or not info.path.endswith(".zip"):
                continue
            inner = info.path[len(folder.rstrip("/")) :]
            dated = re.match(DATED, inner)
            year, name = (int(dated[1]), dated[2]) if dated else (None, inner[1:])
            if year is None and self.years is not None:
                undated.append(info.path)
            elif self.years is None or year in self.years:
                chosen.append((below + info.path, year, name, info.size))
        if undated and self.undated == "error":
            shown = ", ".join(sorted(undated)[:5])
            raise ValueError(f"no year in the paths of {len(undated)} archives below {self.folder}, as {shown}")
        return planned(chosen) or [ArchiveTask([])]

    def read(self, partition: ArchiveTask) -> Iterator[pa.RecordBatch]:
        for archive in partition.archives:
            yield from unpacked(*archive, self.encoding)


class ArchiveSource(DataSource):
    """``spark.read.format("zip_records")``: the records of the zip archives in a folder and all folders below.

    Options: ``years`` (2010,2012; all when left out), ``undated`` (``error``, or ``leave`` to leave out archives without a
    year when years are asked for) and ``encoding``.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def named(listing: DataFrame, folder: str) -> DataFrame:
    """``(year, source_file, path)`` of listed paths below ``folder``; the year is null when there is none."""
    root = listing.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(listing.sparkSession.sparkContext._jsc.hadoopConfiguration())
    whole = system.makeQualified(root).toUri().getPath().rstrip("/")
    inner = F.substr("path", F.instr("path", F.lit(whole)) + len(whole))
    year, name = (F.regexp_extract(inner, DATED, i) for i in (1, 2))
    return listing.select(
        F.when(year != "", year.cast("int")).alias("year"),
        F.when(year != "", name).otherwise(F.substr(inner, F.lit(2))).alias("source_file"),
        "path",
    )


def list_archives(spark: SparkSession, folder: str, years: list[int] | None = None, undated: str = "error") -> DataFrame:
    """``(year, source_file, path)`` of the ``*.zip`` files in ``folder`` and all folders below it; only names are listed.

    When years are asked for, an archive without a year in its path is an error, or with ``undated="leave"`` left out;
    ``left_out`` lists those.
    """
    listing = _listing(spark, folder)
    if years is None:
        return listing
    if undated == "error":
        missing = [row.path for row in listing.where(F.col("year").isNull()).orderBy("path").limit(5).collect()]
        if missing:
            raise ValueError(f"no year in the paths of archives below {folder}, as {', '.join(missing)}")
    return listing.where(F.col("year").isin(years))


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
    return named(files.load(folder), folder)


def left_out(spark: SparkSession, folder: str, years: list[int]) -> DataFrame:
    """``(path, reason)`` of the archives that a run over ``years`` does not read."""
    reason = F.when(F.col("year").isNull(), "no year").when(~F.col("year").isin(years), "other year")
    return _listing(spark, folder).select("path", reason.alias("reason")).where(F.col("reason").isNotNull())


def read_archive_records(
    spark: SparkSession, folder: str, years: list[int] | None = None, encoding: str = "ISO-8859-1", undated: str = "error"
) -> DataFrame:
    """``(year, source_file, record_no, job_xml)``; an archive without exactly one member fails the read."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("zip_records").option("encoding", encoding).option("undated", undated)
    return (reader if years is None else reader.option("years", ",".join(map(str, years)))).load(folder)


def read_archives(
    spark: SparkSession, folder: str, years: list[int] | None = None, encoding: str = "ISO-8859-1", undated: str = "error"
) -> DataFrame:
    """Parsed adverts of all archives, malformed records marked in ``_corrupt_record``."""
    return _parsed(read_archive_records(spark, folder, years, encoding, undated))


def _parsed(records: DataFrame) -> DataFrame:
    return parse_records(records.repartition(*ARCHIVE_KEY), keep=ARCHIVE_KEY)


def unpack_listed(listing: DataFrame, encoding: str = "ISO-8859-1") -> DataFrame:
    """Parsed adverts of the archives in ``listing (year, source_file, path)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from unpacked(row["path"], row["year"], row["source_file"], encoding)

    return _parsed(listing.select("year", "source_file", "path").repartition("path").mapInArrow(run, RECORDS))
