"""Field extraction from captured pages, answered per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.functions.markup import element_text

MISSING_PAGE = "missing page"
MISSING_ELEMENT = "element not found"


def request_symbols(requests: DataFrame, key: str, payload: str, url_prefix: str = "") -> DataFrame:
    """``(key, pos, symbol, url)``: the comma list of a request, not trimmed, each symbol once at its first place."""
    each = requests.select(key, F.posexplode(F.array_distinct(F.split(payload, ","))).alias("pos", "symbol"))
    return each.withColumn("url", F.concat(F.lit(url_prefix), "symbol"))


def page_values(pages: DataFrame, tag: str, attr: str, value: str) -> DataFrame:
    """``(url, value)`` of the latest capture of every page: the text of the element, or the message that it has none.

    The text is taken in the scan, so pages are never shuffled, only the short values.
    """
    text = F.coalesce(element_text("html", tag, attr, value), F.lit(MISSING_ELEMENT))
    return pages.select("url", "page_id", text.alias("value")).groupBy("url").agg(
        F.max_by("value", "page_id").alias("value")
    )


def answers(symbols: DataFrame, values: DataFrame) -> DataFrame:
    """The value of every requested symbol; one without a page gets a message.

    Both sides may be large: Spark picks the join, and splits a symbol asked for in very many requests at run time.
    """
    joined = symbols.join(values, "url", "left")
    return joined.withColumn("value", F.coalesce("value", F.lit(MISSING_PAGE)))


def json_bodies(answered: DataFrame, key: str) -> DataFrame:
    """``(key, body)``: the symbols of a request with their values as one JSON object, in the order asked.

    A symbol that occurs more than once, in one row of requests or in several with the same key, keeps its first place
    and its last value. A group is one request and no longer than the payload it came in.
    """
    # one exchange by request serves both steps; a symbol's first place and last value are aggregates of its own rows
    placed = answered.select(key, "symbol", "pos", "value").repartition(key)
    each = placed.groupBy(key, "symbol").agg(F.min("pos").alias("first"), F.max(F.struct("pos", "value"))["value"].alias("value"))
    asked = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", "symbol", "value"))).alias("_asked"))
    pairs = F.transform("_asked", lambda e: F.struct(e["symbol"], e["value"]))
    return asked.select(key, F.to_json(F.map_from_entries(pairs)).alias("body"))


def json_string(text: Column) -> Column:
    """A single string as JSON."""
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1")


def single_responses(answered: DataFrame, keep: list[str]) -> DataFrame:
    """The one-symbol form: ``{"statusCode": …, "body": …}`` with the body as JSON text of ``symbol: value``."""
    status = F.when(F.col("value") == MISSING_PAGE, 404).otherwise(200)
    message = F.when(
        F.col("value").isin(MISSING_PAGE, MISSING_ELEMENT), F.concat(F.lit("Error: "), "value")
    ).otherwise(F.concat_ws(": ", "symbol", "value"))
    body = F.struct(status.alias("statusCode"), json_string(message).alias("body"))
    return answered.select(*keep, F.to_json(body).alias("response"))
