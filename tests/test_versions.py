import pytest

from gramlode.plans import jobs
from gramlode.session import stored
from gramlode.sinks import versions
from tests.test_jobs import job
from tests.test_sources import put_zip

KINDS = "year int, source_file string, n int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), KINDS)


def archives(spark, *values):
    return stored(spark.createDataFrame(list(values), "year int, source_file string"), "listed")


def seen(spark, root):
    return sorted(tuple(r) for r in versions.read(spark, root).select("year", "source_file", "n").collect())


def test_a_run_replaces_its_partitions_only(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    versions.replace(rows(spark, (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4)), root, archives(spark, (1, "a"), (1, "b"), (2, "a")))
    assert seen(spark, root) == [(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4)]
    # one partition anew, one without rows, one that is new; rows beside the listed partitions do not count
    versions.replace(rows(spark, (1, "a", 9), (3, "c", 5), (2, "a", 77)), root, archives(spark, (1, "a"), (1, "b"), (3, "c")))
    assert seen(spark, root) == [(1, "a", 9), (2, "a", 4), (3, "c", 5)]


def test_nothing_changes_before_the_end(spark, tmp_path):
    root, listed = str(tmp_path / "t"), archives(spark, (1, "a"))
    versions.replace(rows(spark, (1, "a", 1)), root, listed)
    versions.stage(rows(spark, (1, "a", 2)), root, ["year", "source_file"], "late")
    assert seen(spark, root) == [(1, "a", 1)]
    versions.stage(rows(spark, (1, "a", 3)), root, ["year", "source_file"], "late")  # a repeated run replaces itself
    versions.publish(spark, root, listed, "late")
    assert seen(spark, root) == [(1, "a", 3)]


def test_two_runs_cannot_end_as_the_same(spark, tmp_path, monkeypatch):
    root, listed = str(tmp_path / "t"), archives(spark, (1, "a"))
    versions.replace(rows(spark, (1, "a", 1)), root, listed)
    monkeypatch.setattr(versions, "_newest", lambda *_: 0)
    with pytest.raises(RuntimeError, match="another run"):
        versions.replace(rows(spark, (1, "a", 2)), root, listed)
    monkeypatch.undo()
    assert seen(spark, root) == [(1, "a", 1)]


def test_vacuum(spark, tmp_path):
    root, listed = str(tmp_path / "t"), archives(spark, (1, "a"))
    assert versions.vacuum(spark, root) == []
    for i, name in enumerate(["one", "two", "three"]):
        versions.replace(rows(spark, (1, "a", i)), root, listed, name)
    assert versions.vacuum(spark, root) == ["one", "two"]
    assert seen(spark, root) == [(1, "a", 2)] and versions.vacuum(spark, root) == []


def test_no_rows_at_all(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.replace(rows(spark), root, archives(spark, (1, "a")))
    assert seen(spark, root) == [] and versions.read(spark, root).columns == ["year", "source_file", "n"]


def test_archives_are_ingested_once(spark, tmp_path):
    feed, table, state = tmp_path / "feed", str(tmp_path / "t"), str(tmp_path / "state")
    put_zip(feed / "2010" / "a.zip", (job(1, "x") + job(2, "y")).encode())

    def ids():
        return sorted((r.year, r.source_file, r.JobID) for r in versions.read(spark, table).collect())

    jobs.ingest_new_archives(spark, str(feed), table, state)
    assert ids() == [(2010, "a.zip", "1"), (2010, "a.zip", "2")]
    (feed / "2010" / "a.zip").write_bytes(b"broken by now, but not read again")
    put_zip(feed / "2011" / "US" / "a.zip", job(3, "z").encode())
    for _ in range(2):
        jobs.ingest_new_archives(spark, str(feed), table, state)
        assert ids() == [(2010, "a.zip", "1"), (2010, "a.zip", "2"), (2011, "US/a.zip", "3")]
    put_zip(feed / "old" / "b.zip", job(4, "z").encode())
    with pytest.raises(Exception, match="no year"):
        jobs.ingest_new_archives(spark, str(feed), table, state)


def test_versions_that_do_not_count_are_not_listed(spark, tmp_path):
    root, listed = str(tmp_path / "t"), archives(spark, (1, "a"))
    versions.replace(rows(spark, (1, "a", 1)), root, listed, "old")
    versions.replace(rows(spark, (1, "a", 2)), root, listed, "new")
    versions.stage(rows(spark, (1, "a", 3)), root, ["year", "source_file"], "failed")
    files = [f for f in versions.read(spark, root).inputFiles() if "/data/" in f]
    assert files and all("version=new" in f for f in files) and seen(spark, root) == [(1, "a", 2)]
