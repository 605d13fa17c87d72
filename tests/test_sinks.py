import csv
import glob
import os

import pytest

from gramlode.operators import counting
from gramlode.operators.counting import wide_counts
from gramlode.session import stored
from gramlode.sinks import files as sink

COUNTS = "source_file string, job_id string, base string, n bigint"


def wide(spark, rows, bases=("b", "a")):
    return wide_counts(spark.createDataFrame(rows, COUNTS), list(bases), ["source_file", "job_id"])


def archives(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source_file string")


def lines(folder):
    out = []
    for path in sorted(glob.glob(f"{folder}/part-*")):
        with open(path) as f:
            out.append(f.read().splitlines())
    return out


def test_wide_files(spark, tmp_path):
    path = str(tmp_path / "out")
    sink.write_wide_counts(
        wide(spark, [("w1.csv", "1", "a", 2), ("w1.csv", "2", "b", 3), ("w2.csv", "1", "a", 1)]), path, "green"
    )
    first = lines(f"{path}/counts/green/source_file=w1.csv")
    assert len(first) == 1 and first[0][0] == "job_id|a|b" and sorted(first[0][1:]) == ["1|2|", "2||3"]
    # w2 and w3 are run again: w2 has other hits now, w1 stays
    sink.write_wide_counts(wide(spark, [("w2.csv", "9", "b", 5)]), path, "green", archives=archives(spark, "w2.csv", "w3.csv"))
    assert lines(f"{path}/counts/green/source_file=w2.csv") == [["job_id|a|b", "9||5"]]
    assert lines(f"{path}/counts/green/source_file=w1.csv") == first
    # now w2 has no hits at all: nothing of the earlier run may stay
    sink.write_wide_counts(wide(spark, [("w3.csv", "1", "b", 5)]), path, "green", archives=archives(spark, "w2.csv", "w3.csv"))
    assert sorted(d for d in os.listdir(f"{path}/counts/green") if d.startswith("source")) == [
        "source_file=w1.csv",
        "source_file=w3.csv",
    ]


def test_large_archive_is_split(spark, explain, tmp_path):
    df = wide(spark, [("w.csv", "1", "a", 2)]).hint("rebalance", "source_file")
    assert "REBALANCE_PARTITIONS_BY_COL" in explain(df)


def test_snippet_files(spark, tmp_path):
    row = ("green", "w1.csv", "1", "solar", 'a, "b"', "", " text  with spaces ")
    df = spark.createDataFrame(
        [row],
        "tech string, source_file string, job_id string, keyword string, job_title string, occupation string, "
        "jobtext string",
    )
    path = str(tmp_path / "out")
    for _ in range(2):
        sink.write_snippets(df, path, archives=archives(spark, "w1.csv"))
    (file,) = glob.glob(f"{path}/snippets/tech=green/source_file=w1.csv/*.csv")
    with open(file, newline="") as f:
        assert list(csv.reader(f)) == [["job_id", "keyword", "job_title", "occupation", "jobtext"], list(row[2:])]


def test_output_names(spark):
    names = ["US_1.zip", "US_zip.zip", "plain.xml"]
    df = spark.createDataFrame([(n,) for n in names], "n string").coalesce(1)
    got = [r.o for r in df.select(sink.output_name("n").alias("o")).collect()]
    assert got == ["US_1.csv", "US.csv.csv", "plain.xml"]


def test_parquet_is_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("a b", 2)], "bigram string, count bigint")
    for write in (sink.write_new_parquet, sink.write_bigram_counts):
        path = str(tmp_path / write.__name__)
        write(df, path)
        assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a b", 2)]
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
            write(df, path)


def test_lines_of_all_technologies(spark, tmp_path):
    rows = [("w1.csv", i, f"id {i}", "green", "solar", i) for i in range(1, 4)] + [("w1.csv", 1, "id 1", "green", "wind | \"x\"", 7)]
    rows += [("w1.csv", 2, 'a"b|c\\d', "other", "solar", 5), ("w2.csv", 1, "id 1", "other", "solar", 1)]
    counts = stored(spark.createDataFrame(rows, "source_file string, record_no int, job_id string, tech string, base string, n long"), "counts")
    names = [("green", "solar"), ("green", 'wind | "x"'), ("green", "none"), ("other", "solar"), ("unused", "x")]
    keywords = stored(spark.createDataFrame(names, "tech string, base string"), "keywords")
    written = counting.count_lines(counts, keywords, ["source_file", "record_no"], ["source_file"], "job_id")
    path = str(tmp_path / "out")
    for _ in range(2):
        sink.write_count_lines(written, path, archives(spark, "w1.csv", "w2.csv"))
    (file,) = lines(f"{path}/counts/tech=green/source_file=w1.csv")
    assert file[0] == 'job_id|none|solar|"wind | \\"x\\""' and sorted(file[1:]) == ["id 1||1|7", "id 2||2|", "id 3||3|"]
    assert lines(f"{path}/counts/tech=other/source_file=w2.csv") == [["job_id|solar", "id 1|1"]]
    back = spark.read.option("sep", "|").option("header", True).csv(f"{path}/counts/tech=other/source_file=w1.csv").collect()
    assert [(r.job_id, r.solar) for r in back] == [('a"b|c\\d', "5")]
    assert {d for d in os.listdir(f"{path}/counts") if d[0] not in "._"} == {"tech=green", "tech=other"}


def test_number_of_jobs_does_not_grow_with_technologies(spark, tmp_path):
    def jobs(n):
        techs = [(f"t{i}", f"b{i}") for i in range(n)]
        keywords = stored(spark.createDataFrame(techs, "tech string, base string"), "keywords")
        counts = stored(spark.createDataFrame([("w", i, str(i), f"t{i}", f"b{i}", 1) for i in range(n)], "source_file string, record_no int, job_id string, tech string, base string, n long"), "counts")
        group = f"jobs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        sink.write_count_lines(counting.count_lines(counts, keywords, ["source_file", "record_no"], ["source_file"], "job_id"), str(tmp_path / group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(3) == jobs(30)


def test_a_band_reads_few_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would make one file
    counts = spark.range(40_000).selectExpr("'w' || id as bigram", "cast(greatest(1, 20000 / (id + 1)) as long) as count")
    sink.write_bigram_counts(counts.repartition(8), str(tmp_path / "c"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = spark.read.parquet(str(tmp_path / "c"))
    files = lambda df: df.select("_metadata.file_name").distinct().count()
    assert files(table) >= 4 and files(table.where("count > 50")) == 1 and table.count() == 40_000
    assert files(table.where("count = 1")) > 1  # a count that most bigrams have is spread


def test_small_count_files_are_written_by_several_tasks(spark, tmp_path):
    rows = [(f"w{i}.csv", i, str(i), "t", "b", 1) for i in range(40)]
    counts = stored(spark.createDataFrame(rows, "source_file string, record_no int, job_id string, tech string, base string, n long"), "counts")
    keywords = stored(spark.createDataFrame([("t", "b")], "tech string, base string"), "keywords")
    sink.write_count_lines(counting.count_lines(counts, keywords, ["source_file", "record_no"], ["source_file"], "job_id"), str(tmp_path))
    files = [name for _, _, names in os.walk(tmp_path) for name in names if name.startswith("part-")]
    assert len(files) == 40 and len({name.split("-")[1] for name in files}) > 1


def test_count_ranges_are_sorted_by_count_alone(spark, tmp_path, monkeypatch):
    """A sort by bigram would compare strings for most rows, whose counts are equal."""
    df = spark.createDataFrame([("a b", 2), ("c d", 1)], "bigram string, count bigint")
    sorts = []
    sort = type(df).sortWithinPartitions
    monkeypatch.setattr(type(df), "sortWithinPartitions", lambda self, *by: sorts.append(by) or sort(self, *by))
    sink.write_bigram_counts(df, str(tmp_path / "c"))
    assert sorts == [("count",)]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "c")).collect())) == [("a b", 2), ("c d", 1)]
