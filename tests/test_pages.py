import json
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gramlode.functions.markup import decode_entities, element_text
from gramlode.operators import pages as pg


class FirstElement(HTMLParser):
    """Text of the first matching element, by parsing."""

    def __init__(self, tag, attr, value):
        super().__init__(convert_charrefs=True)
        self.want, self.depth, self.text, self.done = (tag, attr, value), 0, None, False
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        name, attr, value = self.want
        if self.done:
            return
        if self.depth:
            self.depth += tag == name
        elif tag == name:
            have = dict(attrs).get(attr)
            if have == value or (attr == "class" and value in (have or "").split()):
                self.depth, self.text = 1, ""

    def handle_startendtag(self, tag, attrs):
        before = self.depth
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)
        assert self.depth == before or self.done

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden -= 1
        if self.depth and not self.done and tag == self.want[0]:
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.depth and not self.done and not self.hidden:
            self.text += data


def parsed(html, *want):
    parser = FirstElement(*want)
    parser.feed(html)
    parser.close()
    return parser.text


PAGES = [
    '<p>x</p><div class="ad">plain</div>',
    '<div class="ad">a<b>b</b><div>c<div>d</div></div>e</div><div class="ad">no</div>',
    "<DIV id=q Class='big ad'>two &amp; &lt;three&gt; &#8217;&#x41; &amp;lt;</DIV>",
    "<div class=ad>bare</div>",
    '<div class="bad">no</div><div class="ads">no</div>',
    '<!-- <div class="ad">hidden</div> --><div class="ad"></div>',
    '<script>var t=\'<div class="ad">s</div>\';</script><div data-x="class=ad">n</div><div class="ad">y</div>',
    '<div class="ad" title="a > b">t<script>no()</script>u<!-- no --></div>',
    '<div class="ad"/>after',
    '<div class="ad">never closed <i>at all</i>',
    '<divx class="ad">n</divx><div\n  class = "ad"\n>new\nline</div>',
    "no markup",
    "",
    '<div class="ad">1 < 2 and &unknown; &#bad;</div>',
]


@pytest.mark.parametrize("want", [("div", "class", "ad"), ("div", "id", "q"), ("fin-streamer", "data-test", "qsp-price")])
def test_element_text_against_a_parser(spark, want):
    extra = '<p><fin-streamer class="c" data-test="qsp-price" v="1">12<span>.5</span></fin-streamer>'
    pages = [*PAGES, extra]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    got = [r.t for r in df.select("id", element_text("html", *want).alias("t")).orderBy("id").collect()]
    assert got == [parsed(p, *want) for p in pages]


def test_long_tags_and_pages(spark):
    attrs = " ".join(f'data-{i}="{"x" * 50}"' for i in range(2000))
    page = f'<div {attrs} class="ad" {attrs}>{"<p>y</p>" * 20000}</div>'
    df = spark.createDataFrame([(page,)], "html string")
    assert df.select(element_text("html", "div", "class", "ad").alias("t")).first().t == "y" * 20000


@pytest.fixture
def answered(spark):
    captured = spark.createDataFrame(
        [
            (1, "http://q/A", '<b class="p">old</b>'),
            (2, "http://q/A", '<b class="p">1.5</b>'),
            (3, "http://q/ B", '<b class="p">é"</b>'),
            (4, "http://q/C", "<i>none</i>"),
        ],
        "page_id bigint, url string, html string",
    )
    requests = spark.createDataFrame([(1, "C,A,Z,A, B"), (2, "A")], "id int, payload string")
    values = pg.page_values(captured, "b", "class", "p")
    return pg.answers(pg.request_symbols(requests, "id", "payload", "http://q/"), values)


def test_values_and_messages(answered):
    assert sorted((r.id, r.symbol, r.value) for r in answered.collect()) == [
        (1, " B", 'é"'),
        (1, "A", "1.5"),
        (1, "C", "element not found"),
        (1, "Z", "missing page"),
        (2, "A", "1.5"),
    ]


def test_bodies(answered):
    bodies = {r.id: r.body for r in pg.json_bodies(answered, "id").collect()}
    want = {"C": "element not found", "A": "1.5", "Z": "missing page", " B": 'é"'}
    assert json.loads(bodies[1]) == want and list(json.loads(bodies[1])) == list(want)
    assert bodies[2] == '{"A":"1.5"}'


def test_single_responses(answered):
    got = {(r.id, r.symbol): json.loads(r.response) for r in pg.single_responses(answered, ["id", "symbol"]).collect()}
    assert got[(1, " B")]["statusCode"] == 200 and json.loads(got[(1, " B")]["body"]) == ' B: é"'
    assert got[(1, "Z")]["statusCode"] == 404 and json.loads(got[(1, "Z")]["body"]) == "Error: missing page"


def test_pages_are_reduced_before_they_move(answered, explain):
    shown = explain(answered)
    exchanges = [line for line in shown.splitlines() if line.startswith("Arguments: hashpartitioning")]
    assert exchanges and "html" not in " ".join(exchanges)


def test_json_bodies_keep_the_last_value_of_a_repeated_symbol(spark):
    rows = [("k", 0, "a", "1"), ("k", 1, "b", "2"), ("k", 2, "a", "3"), ("k", 1, "b", "4"), ("l", 0, "a", "9")]
    frame = spark.createDataFrame(rows, "key string, pos int, symbol string, value string")
    bodies = {r.key: r.body for r in pg.json_bodies(frame, "key").collect()}
    assert bodies == {"k": '{"a":"3","b":"4"}', "l": '{"a":"9"}'}


@pytest.mark.parametrize(
    "text, want",
    [
        ("&eacute;&uuml;&deg;&trade;&yen;&cent;", "éü°™¥¢"),
        ("&#00000065;&#x0000041;&#x1F600;", "AA😀"),
        ("&#xD800;&#0;&#99999999999999999999;&#x110000;", "\ufffd" * 4),
        ("&#38;lt;&amp;lt;", "&lt;&lt;"),
        ("a & b &unknown; &#x; &;&lt", "a & b &unknown; &#x; &;&lt"),
        ("", ""),
    ],
)
def test_references(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(decode_entities(F.col("t")).alias("t")).first().t == want
