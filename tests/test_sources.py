import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gramlode.sources import adverts, archives
from gramlode.sources import tables as src

FEED = """<?xml version='1.0' encoding='ISO-8859-1'?>
<Jobs>
<Job>
<JobID>1</JobID><CanonJobTitle>Engineer</CanonJobTitle><BGTOcc>Tech</BGTOcc>
<JobText>solar &amp; wind
second line </JobText>
</Job>
<Job><JobID>2</JobID><CanonJobTitle></CanonJobTitle><BGTOcc/><JobText>one line</JobText></Job>
<Job><JobID>3</JobID><CanonJobTitle>No occupation</CanonJobTitle><JobText>x</JobText></Job>
<Job><JobID>4</JobID><BGTOcc>No title</BGTOcc><JobText>x</JobText></Job>
<Job><CanonJobTitle>No id</CanonJobTitle><BGTOcc>o</BGTOcc><JobText>caf\xe9</JobText></Job>
<Job><JobID></JobID><CanonJobTitle>Empty id</CanonJobTitle><BGTOcc>o</BGTOcc><JobText>y</JobText></Job>
<Job><JobID>6</JobID><CanonJobTitle>t</CanonJobTitle><BGTOcc>o</BGTOcc><JobText></JobText></Job>
<Job><JobID>7</JobID><CanonJobTitle>t</CanonJobTitle><BGTOcc>o</BGTOcc><JobText>a & b</JobText></Job>
<Job><JobID>8</JobID><CanonJobTitle>cut short
<Job><JobID>9</JobID><CanonJobTitle>t</CanonJobTitle><BGTOcc>o</BGTOcc><JobText>after</JobText></Job>
junk <Job><JobID>10</JobID><CanonJobTitle>t</CanonJobTitle><BGTOcc>o</BGTOcc><JobText>after junk</JobText></Job>
</Jobs>
"""

USABLE = [
    ("0", "Empty id", "o", "y"),
    ("0", "No id", "o", "caf\xe9"),
    ("1", "Engineer", "Tech", "solar & wind\nsecond line "),
    ("10", "t", "o", "after junk"),
    ("2", "", "", "one line"),
    ("9", "t", "o", "after"),
]


def fields(df):
    return sorted(tuple(r) for r in df.select(*adverts.FIELDS).collect())


@pytest.fixture
def feed(tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "a.xml").write_bytes(FEED.encode("latin-1"))
    (folder / "notes.txt").write_text("<Job><JobID>no</JobID></Job>")
    (folder / "nested").mkdir()
    (folder / "nested" / "b.xml").write_bytes(FEED.encode("latin-1"))
    return str(folder)


def test_framed_feed(spark, feed):
    parsed = adverts.read_framed_xml(spark, feed)
    assert fields(adverts.usable(parsed)) == USABLE
    bad = adverts.rejected(parsed).collect()
    assert len(bad) == 1 and "<JobID>7</JobID>" in bad[0]._corrupt_record
    assert [tuple(r) for r in adverts.tally(parsed).collect()] == [("a.xml", 10, 1)]
    assert parsed.select(*adverts.RECORD_KEY).distinct().count() == 10


def test_framed_feed_in_utf8(spark, tmp_path):
    (tmp_path / "u.xml").write_text(FEED.replace("ISO-8859-1", "UTF-8"), encoding="utf-8")
    assert fields(adverts.usable(adverts.read_framed_xml(spark, str(tmp_path), "utf-8"))) == USABLE


def test_framed_records_with_attributes(spark, tmp_path):
    fine = "<JobID>1</JobID><CanonJobTitle/><BGTOcc/><JobText>a</JobText></Job>"
    (tmp_path / "u.xml").write_text(f"""<Jobs><Job id='1'>{fine}<Job a="x>y"\n>{fine}<Job id="{fine}<Job>{fine}</Jobs>""")
    parsed = adverts.read_framed_xml(spark, str(tmp_path), "UTF-8")
    assert adverts.tally(parsed).first()[1:] == (4, 1) and adverts.usable(parsed).count() == 3


def test_framed_feed_in_small_splits(spark, feed):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        parsed = adverts.read_framed_xml(spark, feed)
        assert parsed.rdd.getNumPartitions() > 10
        assert fields(adverts.usable(parsed)) == USABLE
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_row_tag_scan(spark, tmp_path):
    for name in ("a.xml", "b.xml"):
        text = FEED.split("<Job><JobID>3", 1)[0].replace("ISO-8859-1", "UTF-8") + "</Jobs>"
        (tmp_path / name).write_text(text)
    one = adverts.read_xml(spark, str(tmp_path / "a.xml"))
    assert one.schema == adverts.ADVERT
    assert fields(one) == [("1", "Engineer", "Tech", "solar & wind\nsecond line "), ("2", "", "", "one line")]
    assert adverts.read_xml(spark, [str(tmp_path / "a.xml"), str(tmp_path / "b.xml")]).count() == 4
    assert adverts.read_xml(spark, str(tmp_path)).count() == 4
    found = {r.column: r.type for r in adverts.infer_xml(spark, str(tmp_path)).collect()}
    assert found["JobID"] == "bigint" and found["JobText"] == "string"


def test_each_record_is_parsed_once(spark, feed, explain):
    shown = explain(adverts.usable(adverts.read_framed_xml(spark, feed)))
    tree = shown[: shown.index("(1)", shown.index("(1)") + 1)]
    assert tree.index("Filter") < tree.index("Generate")  # the field conditions stay above the parsing


def put_zip(path, *members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for i, member in enumerate(members):
            archive.writestr(f"m{i}.xml", member)


def test_archives(spark, tmp_path):
    put_zip(tmp_path / "z" / "year=2010" / "a.zip", FEED.encode("latin-1"))
    put_zip(tmp_path / "z" / "year=2012" / "b.zip", FEED.encode("latin-1"))
    put_zip(tmp_path / "z" / "year=2012" / "c.zip", b"<Jobs></Jobs>")
    parsed = archives.read_archives(spark, str(tmp_path / "z"))
    assert fields(adverts.usable(parsed)) == sorted(USABLE * 2)
    counts = {r.source_file: (r.processed, r.rejected) for r in adverts.tally(parsed).collect()}
    assert counts == {"a.zip": (10, 1), "b.zip": (10, 1)}
    numbers = [r.record_no for r in parsed.where("source_file = 'a.zip'").orderBy("record_no").collect()]
    assert numbers == list(range(10))
    only = archives.read_archives(spark, str(tmp_path / "z"), years=[2010])
    assert {(r.year, r.source_file) for r in only.collect()} == {(2010, "a.zip")}


def test_listing_reads_names_only(spark, tmp_path, explain):
    put_zip(tmp_path / "z" / "year=2010" / "a.zip", b"")
    put_zip(tmp_path / "z" / "year=2011" / "b.zip", b"")
    listing = archives.list_archives(spark, str(tmp_path / "z"), [2010])
    assert "content" not in explain(listing).split("ReadSchema")[1]
    assert [(r.year, r.source_file) for r in listing.collect()] == [(2010, "a.zip")]


@pytest.fixture(scope="module")
def scattered(tmp_path_factory):
    """Archives at several depths, of the same name, and two without a year. The feed's own path has a year as well."""
    root = tmp_path_factory.mktemp("scattered") / "2009" / "feed"
    one = b"<Jobs><Job><JobID>%d</JobID><CanonJobTitle/><BGTOcc/><JobText>x</JobText></Job></Jobs>"
    for i, name in enumerate(["2014/a.zip", "2014/US/a.zip", "2015/2014/b.zip", "year=2015/CA/q/c.zip", "old/a.zip", "d.zip", "2014b/e.zip"]):
        put_zip(root / name, one % i)
    put_zip(root / "2014" / "note.txt", b"")
    return str(root)


def test_scattered_archives(spark, scattered):
    with pytest.raises(Exception, match="no year in the paths of 3 archives"):
        archives.read_archives(spark, scattered, [2014]).collect()
    with pytest.raises(ValueError, match="no year in the paths"):
        archives.list_archives(spark, scattered, [2014])
    want = {(2014, "a.zip", "0"), (2014, "US/a.zip", "1"), (2014, "b.zip", "2")}
    read = lambda *a, **k: {(r.year, r.source_file, r.JobID) for r in archives.read_archives(spark, scattered, *a, **k).collect()}
    assert read([2014], undated="leave") == want
    listed = archives.list_archives(spark, scattered, [2014], undated="leave").collect()
    assert {(r.year, r.source_file) for r in listed} == {w[:2] for w in want}
    every = want | {(2015, "CA/q/c.zip", "3"), (None, "old/a.zip", "4"), (None, "d.zip", "5"), (None, "2014b/e.zip", "6")}
    assert read() == every
    assert {(r.year, r.source_file) for r in archives.list_archives(spark, scattered).collect()} == {w[:2] for w in every}
    gone = {(r.path.split("/feed/")[1], r.reason) for r in archives.left_out(spark, scattered, [2014]).collect()}
    assert gone == {("year=2015/CA/q/c.zip", "other year"), ("old/a.zip", "no year"), ("d.zip", "no year"), ("2014b/e.zip", "no year")}
    assert read([1999], undated="leave") == set()


def test_tasks_have_about_the_same_size():
    found = [(f"p{i}", 2014, f"n{i}", size) for i, size in enumerate([10, 200, 60, 60, 60, 5])]
    tasks = [[a[0] for a in t.archives] for t in archives.planned([(p, y, n, s << 20) for p, y, n, s in found])]
    assert tasks == [["p1"], ["p2", "p3"], ["p4", "p0", "p5"]]
    assert len(archives.planned([("p", 1, "n", 0)] * 2500)) == 3 and archives.planned([]) == []


def test_archive_with_two_members_fails(spark, tmp_path):
    put_zip(tmp_path / "z" / "a.zip", b"<Job></Job>", b"<Job></Job>")
    with pytest.raises(Exception, match="expected one member, found 2"):
        archives.read_archives(spark, str(tmp_path / "z")).collect()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 64, 10_000])
def test_framing_at_any_chunk_size(size):
    data = b"x<Job>a</Job>\n<Job>cut<Job>b</Job></Job>none</Job><Job><Jo</Job><Job>open"
    stream = io.BytesIO(data)
    got = list(archives.frame(iter(lambda: stream.read(size), b"")))
    assert got == [b"<Job>a</Job>", b"<Job>b</Job>", b"<Job><Jo</Job>"]


def test_text_without_records_is_not_kept():
    seen = []

    def chunks():
        for _ in range(200):
            yield b"z" * 1000
            seen.append(1)

    assert list(archives.frame(chunks())) == [] and len(seen) == 200


def test_years(spark, tmp_path, explain):
    df = spark.createDataFrame([(i, 2000 + i % 6) for i in range(60)], "id int, year int")
    df.write.partitionBy("year").parquet(str(tmp_path / "y"))
    chosen = spark.read.parquet(str(tmp_path / "y")).where(src.in_years(2001, 2004, skip=[2002]))
    assert sorted({r.year for r in chosen.collect()}) == [2001, 2003, 2004]
    assert "PartitionFilters: [isnotnull(year" in explain(chosen)
    assert df.where(src.in_years(2001, 2004)).count() == 40


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    assert [r.value for r in src.read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "", "two"]
    assert src.read_lines(spark, [str(tmp_path / "a.txt")] * 2).where(F.col("value") != "").count() == 4


def test_archives_in_plain_year_folders(spark, tmp_path):
    for year in (2013, 2014):
        (tmp_path / "feed" / str(year)).mkdir(parents=True)
        (tmp_path / "feed" / str(year) / "a.zip").write_bytes(b"x")
    found = archives.list_archives(spark, str(tmp_path / "feed"), [2014]).collect()
    assert [(r.year, r.source_file, r.path.rsplit("/", 2)[1]) for r in found] == [(2014, "a.zip", "2014")]
    assert archives.list_archives(spark, str(tmp_path / "feed")).count() == 2
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.zip").write_bytes(b"x")
    with pytest.raises(ValueError, match="no year"):
        archives.list_archives(spark, str(tmp_path / "flat"), [2014])
