import json

import pytest

from gramlode.operators import dictionary as d
from gramlode.plans import jobs
from tests.test_counting import advert
from tests.test_sinks import lines
from tests.test_sources import put_zip


def job(number, text, title="t", occupation="o"):
    return (
        f"<Job>\n<JobID>{number}</JobID><CanonJobTitle>{title}</CanonJobTitle>\n<BGTOcc>{occupation}</BGTOcc>"
        f"<JobText>{text}</JobText>\n</Job>\n"
    )


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    first = job(1, advert("solar", "wind", "powers", "solar")) + job(2, advert("reactors")) + job(3, advert("a & b"))
    put_zip(folder / "year=2010" / "w1.zip", f"<Jobs>\n{first}</Jobs>".encode("latin-1"))
    put_zip(folder / "year=2010" / "w2.zip", b"<Jobs></Jobs>")
    put_zip(folder / "year=2011" / "w3.zip", job(4, advert("solar")).encode())
    put_zip(folder / "year=2012" / "w4.zip", job(5, advert("solar"), title="S&#233;nior, a").encode())
    return str(folder)


SHEETS = {"green": ["solar", "wind_power1", "reactor"], "other": ["solar"]}


def test_feed_to_count_files(spark, feed, tmp_path):
    table, out = str(tmp_path / "adverts"), str(tmp_path / "out")
    for _ in range(2):  # running again replaces
        names = jobs.ingest_archives(spark, feed, table, 2010, 2012, skip=[2011])
        assert sorted(map(tuple, names.collect())) == [(2010, "w1.zip"), (2010, "w2.zip"), (2012, "w4.zip")]
        jobs.count_adverts(spark, table, d.literal_sheets(spark, SHEETS), out, names, snippet_share=1.0)
    tally = {tuple(r) for r in jobs.ingest_tally(spark, table).collect()}
    assert tally == {(2010, "w1.zip", 3, 1), (2012, "w4.zip", 1, 0)}
    (file,) = lines(f"{out}/counts/tech=green/year=2010/source_file=w1.csv")
    assert file[0] == "job_id|reactor|solar|wind power" and sorted(file[1:]) == ["1||2|1", "2|1||"]
    assert lines(f"{out}/counts/tech=other/year=2010/source_file=w1.csv") == [["job_id|solar", "1|2"]]
    assert lines(f"{out}/counts/tech=green/year=2012/source_file=w4.csv") == [["job_id|reactor|solar|wind power", "5||1|"]]
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{out}/snippets")
    assert sorted((r.tech, r.source_file, r.job_id, r.keyword, r.job_title) for r in rows.collect()) == [
        ("green", "w1.csv", "1", "solar", "t"),
        ("green", "w1.csv", "1", "wind power", "t"),
        ("green", "w1.csv", "2", "reactor", "t"),
        ("green", "w4.csv", "5", "solar", "Sénior, a"),
        ("other", "w1.csv", "1", "solar", "t"),
        ("other", "w4.csv", "5", "solar", "Sénior, a"),
    ]


def test_years_share_archive_names(spark, tmp_path):
    feed, table, out = (str(tmp_path / n) for n in ("feed", "adverts", "out"))
    solar = advert("solar")
    put_zip(tmp_path / "feed" / "2010" / "w.zip", job(0, solar).encode())
    put_zip(tmp_path / "feed" / "2011" / "w.zip", (job(0, advert("solar", "solar")) + job(0, solar)).encode())
    sheets = d.literal_sheets(spark, {"gr/een": ["solar"]})

    def counted(start, end):
        listed = jobs.ingest_archives(spark, feed, table, start, end)
        jobs.count_adverts(spark, table, sheets, out, listed, snippet_share=1.0)
        rows = spark.read.option("header", True).option("sep", "|").csv(f"{out}/counts/tech=gr%2Feen")
        return sorted((r.year, r.source_file, r.solar) for r in rows.collect())

    assert counted(2010, 2011) == [(2010, "w.csv", "1"), (2011, "w.csv", "1"), (2011, "w.csv", "2")]
    # 2011 has no record any more: its rows go from the table, the counts and the snippets; 2010 stays
    put_zip(tmp_path / "feed" / "2011" / "w.zip", b"<Jobs></Jobs>")
    assert counted(2011, 2011) == [(2010, "w.csv", "1")]
    assert [tuple(r) for r in jobs.ingest_tally(spark, table).collect()] == [(2010, "w.zip", 1, 0)]
    snippets = spark.read.option("header", True).csv(f"{out}/snippets")
    assert [(r.tech, r.year) for r in snippets.collect()] == [("gr/een", 2010)]


def test_synonyms_from_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<Jobs>" + job(1, "clean energy and green energy and old coal") + "</Jobs>")
    found = jobs.explore_synonyms(spark, str(tmp_path / "a.xml"), str(tmp_path / "c"), "clean energy", "energy")
    assert {r.bigram for r in found.collect()} == {"clean energy", "green energy"}


def test_labels_from_file(spark, tmp_path):
    (tmp_path / "l.txt").write_text("solar\nwind\n")
    docs = spark.createDataFrame([(1, "wind")], "id int, text string")
    best = jobs.rank_labels(spark, docs, str(tmp_path / "l.txt"), ["id"], "text").where("rank = 1")
    assert [r.label for r in best.collect()] == ["wind"]


def test_requests(spark):
    captured = spark.createDataFrame([(1, "u/A", '<b class="p">1</b>')], "page_id int, url string, html string")
    requests = spark.createDataFrame([(1, "A,B")], "id int, payload string")
    (row,) = jobs.answer_requests(requests, captured, "id", "payload", "b", "class", "p", "u/").collect()
    assert json.loads(row.body) == {"A": "1", "B": "missing page"}
