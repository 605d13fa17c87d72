"""The registered queries: each takes a session and a folder of tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.functions import text as tx
from gramlode.operators import bigrams, counting, dictionary, labels, pages
from gramlode.plans import jobs
from gramlode.plans import tables as tb
from gramlode.session import scratch_path, stored
from gramlode.sinks import files as sink
from gramlode.sinks import versions
from gramlode.sources import adverts, archives
from gramlode.sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BASE_BIGRAM = "of the"
CORE = "the"
BAND = 0.7
KEY = ["doc_id"]
AD_ELEMENT = ("div", "class", "ad")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- text -----------------------------------------------------------------------------------------------------------


@query
def clean_tokens(spark, sf):
    tokens = tx.with_clean_tokens(tb.documents(spark, sf, "text"), KEY, "text")
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def trim_tokens(spark, sf):
    tokens = tx.with_trimmed_tokens(tb.documents(spark, sf, "text"), KEY, "text")
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def clean_bigrams(spark, sf):
    tokens = tx.with_trimmed_tokens(tb.documents(spark, sf, "text"), KEY, "text")
    pairs = tokens.select("doc_id", tx.ngrams("tokens", 2).alias("pairs"))
    return pairs.select("doc_id", F.size("pairs").alias("n_bigrams"), F.array_join("pairs", "|").alias("bigrams"))


@query
def nlp_tokens(spark, sf):
    tokens = tx.with_raw_tokens(tb.documents(spark, sf, "text"), KEY, "text")
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def nlp_ngrams(spark, sf):
    tokens = tx.with_raw_tokens(tb.documents(spark, sf, "text"), KEY, "text")
    grams = tokens.select("doc_id", tx.ngrams("tokens", 3).alias("grams"))
    return grams.select("doc_id", F.size("grams").alias("n_grams"), F.array_join("grams", "|").alias("grams"))


@query
def nested_project(spark, sf):
    tokens = tx.with_raw_tokens(tb.documents(spark, sf, "text"), KEY, "text")
    annotated = tokens.select(
        "doc_id",
        F.transform(
            tx.ngrams("tokens", 2), lambda g: F.struct(F.lit("chunk").alias("type"), g.alias("result"))
        ).alias("bigrams"),
    )
    result = annotated.select("doc_id", "bigrams.result")
    return result.select("doc_id", F.size("result").alias("n"), F.array_join("result", "|").alias("result"))


# ---- keyword dictionary ---------------------------------------------------------------------------------------------


@query
def keyword_dict(spark, sf):
    return dictionary.keyword_dict(tb.derived_sheets(spark, sf)).select("tech", "base")


@query
def keyword_sheets(spark, sf):
    """The sheets written as CSV below tech=<name>/ and read back by partition discovery."""
    path = scratch_path(spark, "sheets")
    # writing into folders sorts all that a task has
    sheets = tb.derived_sheets(spark, sf, by_size=True).select("tech", F.col("raw").alias("bigrams"))
    sheets.write.partitionBy("tech").option("header", "true").csv(path)
    read = src.read_keyword_sheets(spark, path, order=tb.ROLES)
    return dictionary.keyword_dict(read).select("tech", "tech_pos", "base")


@query
def dict_size(spark, sf):
    return dictionary.dict_size(dictionary.keyword_dict(tb.derived_sheets(spark, sf)))


@query
def inflect(spark, sf):
    bases = dictionary.keyword_dict(tb.derived_sheets(spark, sf)).select("base").distinct()
    return dictionary.with_forms(bases)


@query
def surface_dict(spark, sf):
    return dictionary.surface_dict(dictionary.keyword_dict(tb.derived_sheets(spark, sf)))


@query
def surface_dict_short(spark, sf):
    return dictionary.surface_dict(dictionary.keyword_dict(tb.derived_sheets(spark, sf)), inflect=False)


# ---- counting per advert --------------------------------------------------------------------------------------------


@query
def gram_counts_per_job(spark, sf):
    return counting.gram_counts(tb.documents(spark, sf, "text"), KEY, "text")


@query
def surface_counts_per_job(spark, sf):
    _, surfaces, _ = tb.literal_dictionary(spark)
    return counting.surface_counts(tb.documents(spark, sf, "text"), surfaces, KEY, "text")


@query
def keyword_counts(spark, sf):
    _, _, matches = tb.literal_dictionary(spark)
    return counting.keyword_counts(tb.documents(spark, sf, "text"), matches, KEY, "text")


@query
def keyword_counts_short(spark, sf):
    """Without inflection only words of up to five characters are looked up."""
    _, _, matches = tb.literal_dictionary(spark, inflect=False)
    return counting.keyword_counts(tb.documents(spark, sf, "text"), matches, KEY, "text")


def _derived_matches(spark, sf):
    keywords = stored(dictionary.keyword_dict(tb.derived_sheets(spark, sf)), "keywords")
    return stored(dictionary.matcher(dictionary.surface_dict(keywords), keywords), "matches")


@query
def keyword_counts_large(spark, sf):
    """A dictionary that grows with the data, joined as its size asks for."""
    return counting.keyword_counts(tb.documents(spark, sf, "text"), _derived_matches(spark, sf), KEY, "text")


@query
def keyword_counts_shuffled(spark, sf):
    """The same, joined as a dictionary beyond every bound: hot grams where they are made, the others by sort-merge."""
    return counting.keyword_counts(tb.documents(spark, sf, "text"), _derived_matches(spark, sf), KEY, "text", small=False)


@query
def job_semi(spark, sf):
    _, surfaces, _ = tb.literal_dictionary(spark)
    docs = tb.documents(spark, sf, "text", "lang", "source")
    return counting.adverts_with_hits(docs, surfaces, KEY, "text").select("doc_id", "lang", "source")


@query
def job_semi_words(spark, sf):
    """Every single word of the conversations is a form, looked up inside the advert's row like the few of `job_semi`."""
    forms = tb.derived_sheets(spark, sf).select(F.regexp_extract("raw", "^([a-z]+)[0-9]$", 1).alias("surface"))
    surfaces = stored(forms.where("surface <> ''").distinct(), "surfaces")
    docs = tb.documents(spark, sf, "text", "lang", "source")
    return counting.adverts_with_hits(docs, surfaces, KEY, "text").select("doc_id", "lang", "source")


@query
def job_semi_large(spark, sf):
    docs = tb.documents(spark, sf, "text", "lang", "source")
    return counting.adverts_with_hits(docs, _derived_matches(spark, sf), KEY, "text").select("doc_id", "lang", "source")


@query
def job_techs(spark, sf):
    _, _, matches = tb.literal_dictionary(spark)
    found = counting.hits(tb.documents(spark, sf, "text"), matches, KEY, "text")
    return counting.advert_techs(found, KEY).select("doc_id", F.array_join("techs", ",").alias("techs"))


def _literal_bases() -> list[str]:
    digits = str.maketrans("_", " ", "0123456789")
    return sorted({raw.translate(digits) for raws in tb.SHEETS.values() for raw in raws})


@query
def counts_wide(spark, sf):
    """All technologies side by side; a technology's file takes its own rows and columns of this."""
    _, _, matches = tb.literal_dictionary(spark)
    found = counting.hits(tb.documents(spark, sf, "text"), matches, KEY, "text")
    return counting.wide_counts(found, _literal_bases(), ["doc_id", "tech"], n=None)


@query
def snippet_rows(spark, sf):
    return _snippets(spark, sf, 1.0)


@query
def snippet_sample(spark, sf):
    return _snippets(spark, sf, 0.1)


@query
def snippet_sample_rare(spark, sf):
    return _snippets(spark, sf, 0.001)


@query
def snippet_sample_large(spark, sf):
    return _snippets(spark, sf, 0.001, _derived_matches(spark, sf))


def _snippets(spark, sf, p, matches=None):
    matches = tb.literal_dictionary(spark)[2] if matches is None else matches
    docs = tb.documents(spark, sf, "text", "lang", "source")
    found = counting.snippets(docs, matches, KEY, "text", "doc_id", "lang", "source", p)
    return found.select("tech", "job_id", "keyword", "job_title", "occupation", "jobtext")


# ---- bigrams over the corpus ----------------------------------------------------------------------------------------


def _counts(spark, sf):
    return bigrams.bigram_counts(tb.documents(spark, sf, "text"), "text")


def _stored_counts(spark, sf):
    path = scratch_path(spark, "bigram_counts")
    sink.write_bigram_counts(_counts(spark, sf), path)
    return spark.read.schema("bigram string, count bigint").parquet(path)


@query
def bigram_count(spark, sf):
    return _counts(spark, sf)


@query
def bigram_sorted(spark, sf):
    return bigrams.most_frequent_first(_counts(spark, sf))


@query
def bigram_topk(spark, sf):
    return bigrams.most_frequent_first(_counts(spark, sf)).limit(100)


@query
def cast_count(spark, sf):
    return _counts(spark, sf).withColumn("count", F.col("count").cast("int"))


@query
def row_counts(spark, sf):
    docs = tb.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
    counted = _counts(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return docs.select(F.lit("documents").alias("name"), "n").union(counted.select(F.lit("bigrams"), "n"))


@query
def base_lookup(spark, sf):
    return _stored_counts(spark, sf).where(F.col("bigram") == BASE_BIGRAM)


@query
def band_filter(spark, sf):
    return bigrams.frequency_band(_stored_counts(spark, sf), BASE_BIGRAM, BAND)


@query
def synonym_candidates(spark, sf):
    return bigrams.synonym_candidates(_stored_counts(spark, sf), BASE_BIGRAM, CORE, BAND)


@query
def parquet_roundtrip(spark, sf):
    return _stored_counts(spark, sf)


# ---- labels ---------------------------------------------------------------------------------------------------------


@query
def label_score(spark, sf):
    scored = labels.label_scores(tb.documents(spark, sf, "text"), tb.LABELS, KEY, "text")
    return scored.withColumn("score", F.round("score", 6))


@query
def label_score_frequent(spark, sf):
    scored = labels.label_scores(tb.documents(spark, sf, "text"), tb.FREQUENT_LABELS, KEY, "text")
    return scored.withColumn("score", F.round("score", 6))


@query
def label_score_model(spark, sf):
    """A model in the scorer's place."""
    scorer = labels.loaded_scorer(labels.letter_rate, 0.5)
    scored = labels.label_scores(tb.documents(spark, sf, "text"), tb.LABELS, KEY, "text", scorer)
    return scored.withColumn("score", F.round("score", 6))


@query
def label_score_many(spark, sf):
    """Every pair of words that opens a turn of a conversation is a label; the ten best of each document."""
    words = tx.clean_tokens("text")
    turns = tb.table(spark, sf, "conversations").select(F.slice(words, 1, 2).alias("w")).where(F.size("w") == 2)
    names = turns.select(F.array_join("w", " ").alias("label")).distinct().orderBy("label")
    path = scratch_path(spark, "labels")
    names.coalesce(1).write.text(path)
    given = stored(src.read_labels(spark, path).select(F.col("pos").cast("long").alias("pos"), "label"), "labels")
    scored = labels.top_labels(tb.documents(spark, sf, "text"), given, KEY, "text")
    return scored.withColumn("score", F.round("score", 6))


def _label_file(spark, sf):
    """A label file with blank lines, made of the part names in order."""
    path = scratch_path(spark, "labels")
    names = tb.table(spark, sf, "part").select("p_name").distinct().orderBy("p_name").coalesce(1)
    names.select(F.explode(F.array("p_name", F.lit(""))).alias("value")).write.text(path)
    return path


@query
def label_list(spark, sf):
    """The label file read with the numbers of its lines."""
    return src.read_labels(spark, _label_file(spark, sf)).select("pos", "label")


# ---- pages ----------------------------------------------------------------------------------------------------------


def _requests(spark, sf):
    """Ten pages per request, without the common start of their addresses; one symbol twice and one without a page."""
    symbols = tb.table(spark, sf, "pages").select(
        F.floor(F.col("page_id") / 10).alias("request_id"), "page_id", F.expr("substring(url, 5)").alias("symbol")
    )
    grouped = symbols.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("page_id", "symbol"))).alias("s"))
    listed = grouped.select("request_id", F.transform("s", lambda e: e["symbol"]).alias("s"))
    absent = F.concat(F.lit("://absent/"), F.col("request_id").cast("string"))
    return listed.select(
        "request_id", F.array_join(F.concat("s", F.array(absent, F.element_at("s", 1))), ",").alias("payload")
    )


def _answered(spark, sf, element=AD_ELEMENT):
    captured = tb.spread(tb.table(spark, sf, "pages").select("page_id", "url", "html"), "url")
    values = pages.page_values(captured, *element)
    symbols = pages.request_symbols(_requests(spark, sf), "request_id", "payload", url_prefix="http")
    return pages.answers(symbols, values)


@query
def page_extract(spark, sf):
    return _answered(spark, sf).select("request_id", "symbol", "value")


@query
def page_extract_missing(spark, sf):
    return _answered(spark, sf, ("fin-streamer", "data-test", "qsp-price")).select("request_id", "symbol", "value")


@query
def page_json(spark, sf):
    return pages.json_bodies(_answered(spark, sf), "request_id")


@query
def page_response(spark, sf):
    return pages.single_responses(_answered(spark, sf), ["request_id", "symbol"])


# ---- sources --------------------------------------------------------------------------------------------------------


@query
def xml_scan(spark, sf):
    return adverts.read_xml(spark, tb.write_xml_feed(spark, sf))


@query
def xml_framed_scan(spark, sf):
    """The same feed, with attributes on some records, cut into records by the text source."""
    parsed = adverts.read_framed_xml(spark, tb.write_xml_feed(spark, sf, attributes=True), encoding="UTF-8")
    return adverts.usable(parsed).select(*adverts.FIELDS)


@query
def xml_infer(spark, sf):
    return adverts.infer_xml(spark, tb.write_xml_feed(spark, sf))


@query
def zip_scan(spark, sf):
    parsed = archives.read_archives(spark, tb.write_zip_feed(spark, sf))
    return adverts.usable(parsed).select("year", "source_file", *adverts.FIELDS)


@query
def zip_years(spark, sf):
    """Two of three year folders."""
    last = tb.FIRST_YEAR + tb.YEAR_FOLDERS - 1
    years = [y for y in range(tb.FIRST_YEAR, last + 1) if y != tb.FIRST_YEAR + 1]
    parsed = archives.read_archives(spark, tb.write_zip_feed(spark, sf), years)
    return adverts.usable(parsed).select("year", "source_file", "JobID", F.length("JobText").alias("n_chars"))


def _scattered_name():
    """Paths of archives: below a year at two depths, every fifth without a year."""
    year = tb.archive_year()
    folder = (
        F.when(tb.archive_number() % 5 == 4, "old/")
        .when(tb.archive_number() % 2 == 0, F.concat(year, F.lit("/US/east/")))
        .otherwise(F.concat(F.lit("year="), year, F.lit("/")))
    )
    return F.concat(folder, tb.archive_name())


CHOSEN_YEARS = [tb.FIRST_YEAR, tb.FIRST_YEAR + 2]


@query
def archives_nested(spark, sf):
    """Archives at several depths; those without a year are left out."""
    feed = tb.write_zip_feed(spark, sf, name=_scattered_name())
    parsed = archives.read_archives(spark, feed, CHOSEN_YEARS, undated="leave")
    return adverts.usable(parsed).select("year", "source_file", "JobID", F.length("JobText").alias("n_chars"))


@query
def archives_left_out(spark, sf):
    """What a run over the same archives does not read, and why."""
    out = archives.left_out(spark, tb.write_zip_feed(spark, sf, name=_scattered_name()), CHOSEN_YEARS)
    return out.select(F.substring_index("path", "/", -1).alias("archive"), "reason")


@query
def archives_incremental(spark, sf):
    """A folder that grows between two calls, each of which takes what is new."""
    feed, table, state = (scratch_path(spark, name) for name in ("feed", "adverts", "state"))
    early = tb.archive_number() % 2 == 0
    for chosen in (early, ~early):
        tb.write_zip_feed(spark, sf, path=feed, chosen=chosen)
        jobs.ingest_new_archives(spark, feed, table, state)
    return adverts.usable(versions.read(spark, table)).select("year", "source_file", *adverts.FIELDS)


@query
def archives_replaced(spark, sf):
    """Ingested; written anew with some archives emptied, but failing before the end; done again. What a reader sees after
    each step."""
    table, last = scratch_path(spark, "adverts"), tb.FIRST_YEAR + tb.YEAR_FOLDERS - 1
    emptied = tb.archive_number() % 4 == 1

    def seen(step):
        rows = versions.read(spark, table).groupBy("year", "source_file").agg(F.count(F.lit(1)).alias("n"))
        return stored(rows.select(F.lit(step).alias("step"), "*"), "seen")

    jobs.ingest_archives(spark, tb.write_zip_feed(spark, sf), table, tb.FIRST_YEAR, last)
    steps = [seen("first")]
    again = tb.write_zip_feed(spark, sf, blank=emptied)
    versions.stage(archives.read_archives(spark, again), table, ["year", "source_file"], "failed")
    steps.append(seen("failed"))
    jobs.ingest_archives(spark, again, table, tb.FIRST_YEAR, last)
    return steps[0].union(steps[1]).union(seen("done"))


def _broken_archives(spark, sf):
    return archives.read_archives(spark, tb.write_zip_feed(spark, sf, broken=F.col("lang") == "de"))


@query
def xml_reject(spark, sf):
    bad = adverts.rejected(_broken_archives(spark, sf))
    return bad.select("source_file", F.regexp_extract(adverts.CORRUPT, "<JobID>([0-9]+)</JobID>", 1).alias("job_id"))


@query
def ingest_tally(spark, sf):
    return adverts.tally(_broken_archives(spark, sf))


@query
def archive_keyword_counts(spark, sf):
    """From archives to counts in one plan, malformed records left out."""
    _, _, matches = tb.literal_dictionary(spark)
    usable = adverts.usable(_broken_archives(spark, sf))
    counts = counting.keyword_counts(usable, matches, adverts.ARCHIVE_KEY, "JobText", carry=["JobID"])
    return counts.select("source_file", F.col("JobID").alias("job_id"), "tech", "base", "n")


@query
def text_scan(spark, sf):
    path = scratch_path(spark, "lines")
    tb.documents(spark, sf, "text").select("text").write.text(path)
    return src.read_lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query
def required_fields(spark, sf):
    docs = tb.documents(spark, sf, "text", "lang", "source")
    holes = docs.select(
        "doc_id",
        F.when(F.col("lang") != "fr", F.col("doc_id").cast("string")).alias("JobID"),
        F.when(F.col("source") != "src3", F.col("lang")).alias("CanonJobTitle"),
        F.when(F.col("source") == "src5", "").when(F.col("source") != "src7", F.col("source")).alias("BGTOcc"),
        F.when(F.col("source") != "src9", F.col("text")).otherwise("").alias("JobText"),
    )
    return adverts.usable(holes).select(
        "doc_id", "JobID", "CanonJobTitle", "BGTOcc", F.length("JobText").alias("n_chars")
    )


@query
def year_select(spark, sf):
    """Orders below year folders; the skipped year's folder is not read."""
    path = scratch_path(spark, "orders")
    orders = tb.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    orders.write.partitionBy("year").parquet(path)
    return spark.read.parquet(path).where(src.in_years(1995, 1999, skip=[1997])).select(
        "year", "o_orderkey", "o_totalprice"
    )


@query
def top_k(spark, sf):
    orders = tb.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(70)


# ---- sinks ----------------------------------------------------------------------------------------------------------


@query
def file_rename(spark, sf):
    docs = tb.table(spark, sf, "documents")
    names = docs.select(F.concat_ws("_", "lang", "source").alias("stem")).distinct()
    files = names.select(F.explode(F.array(F.concat("stem", F.lit(".zip")), F.concat("stem", F.lit("_zip.zip")))))
    return files.select(F.col("col").alias("source_file"), sink.output_name("col").alias("output_file"))


def _archive_counts(spark, sf, carry=()):
    _, _, matches = tb.literal_dictionary(spark)
    docs = tb.documents(spark, sf, "text", *carry).withColumn("source_file", tb.archive_name())
    return docs, matches


@query
def counts_sink(spark, sf):
    """Wide count files per technology, read back as one table. The long counts are stored once; the second write replaces
    the first."""
    docs, matches = _archive_counts(spark, sf)
    counts = counting.keyword_counts(docs, matches, ["source_file", "doc_id"], "text")
    counts = stored(counts.withColumn("source_file", sink.output_name("source_file")), "counts")
    keywords, path = tb.literal_dictionary(spark)[0], scratch_path(spark, "count_files")
    lines = counting.count_lines(counts, keywords, ["source_file", "doc_id"], ["source_file"], "doc_id")
    for _ in range(2):
        sink.write_count_lines(lines, path, counts.select("source_file").distinct())
    return _read_counts(spark, path, {"source_file": "string"})


def _read_counts(spark, path, partitions):
    """The count files of the small workbook, turned back into one long table."""
    read = None
    for tech, raws in tb.SHEETS.items():
        bases = sorted({raw.translate(str.maketrans("_", " ", "0123456789")) for raw in raws})
        columns = {"job_id": "string", **dict.fromkeys(bases, "bigint"), "tech": "string", **partitions}
        schema = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
        # only this technology's files are listed; one without hits has none
        read_files = spark.read.schema(schema).option("sep", "|").option("header", "true").option("enforceSchema", "true")
        folder = f"{path}/counts/tech={sink.folder_name(spark, tech)}"
        if sink.exists(spark, folder):
            back = read_files.option("basePath", f"{path}/counts").csv(folder).drop("tech")
        else:
            back = spark.createDataFrame([], schema).drop("tech")
        long = counting.long_counts(back, bases, [*partitions, "job_id"]).withColumn("tech", F.lit(tech))
        read = long if read is None else read.unionByName(long)
    return read.select(*partitions, "job_id", "tech", "base", "n")


@query
def job_keyword_counts(spark, sf):
    """The whole job: archives in plain year folders, the same names in each, ingested and counted into files."""
    feed = tb.write_zip_feed(spark, sf, broken=F.col("lang") == "de", plain=True)
    table, out = scratch_path(spark, "adverts"), scratch_path(spark, "job_files")
    listed = jobs.ingest_archives(spark, feed, table, tb.FIRST_YEAR, tb.FIRST_YEAR + tb.YEAR_FOLDERS - 1)
    jobs.count_adverts(spark, table, dictionary.literal_sheets(spark, tb.SHEETS), out, listed)
    return _read_counts(spark, out, {"year": "int", "source_file": "string"})


@query
def snippet_sink(spark, sf):
    docs, matches = _archive_counts(spark, sf, ("lang", "source"))
    docs = docs.withColumn("source_file", sink.output_name("source_file"))
    rows = counting.snippets(docs, matches, ["source_file", "doc_id"], "text", "doc_id", "lang", "source", 0.1)
    path = scratch_path(spark, "snippet_files")
    sink.write_snippets(rows.drop("doc_id"), path)
    schema = "job_id string, keyword string, job_title string, occupation string, jobtext string"
    return (
        spark.read.schema(f"{schema}, tech string, source_file string")
        .option("header", "true")
        .option("escape", '"')
        .csv(f"{path}/snippets")
        .select("tech", "source_file", "job_id", "keyword", "job_title", "occupation", "jobtext")
    )
