from gramlode.llm import html

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">menu one</a></li>'
    '<li><a href="/b">menu two</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div><article><h1>The title</h1>'
    "<p><b>First &amp; best words of the\n text<br><p>Second block has &eacute;t&#233; words.</p><script>var t='</p>';</script>"
    '<form><button>Send</button> your mail</form><div class="comments"><p>I like it very much indeed.</p></div>'
    "<p>Last block of the article stays.</p></article><footer>&copy; someone and more words here</footer></body></html>"
)
WANT = "The title\nFirst & best words of the text\nSecond block has été words.\nLast block of the article stays."


def test_article_only(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "plain words only"), (None, "u", PAGE), (1, "u", PAGE)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")
    got = html.extract(frame).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts == {1: WANT, 2: "", 3: "", 4: "", 5: "plain words only", None: WANT}
    assert html.extract(frame.limit(0)).count() == 0


def test_without_labelled_pages_dense_words_win():
    page = "<div class='menu'><a>one</a><a>two</a></div><div class='story'><p>" + "many good words " * 20 + "</p></div><div><a>x</a></div>"
    assert html.main_text(page, {}) == " ".join(["many good words"] * 20)


def test_cut_and_odd_pages():
    assert html.main_text("<article><p>some words are here &am", {}) == "some words are here &am"
    assert html.main_text("<article><p>some words are here</p><foo", {}) == "some words are here"
    assert html.main_text("a < b and more words <p title='>'>x y z", {}) == "a < b and more words\nx y z"
    assert html.main_text("<div>" * 3000 + "words " * 4000, {}).startswith("words words")


def test_best_stretch_is_the_maximum():
    import random

    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-2, -1, 0.5, 1]) for _ in range(rng.randint(0, 12))]
        sums = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        a, b = html.best_stretch(scores)
        assert sum(scores[a:b]) == max([0, *sums])


def test_elements_close_over_any_number_of_omitted_end_tags():
    after = "<article><p>" + "many good words " * 20 + "</p></article>"
    want = " ".join(["many good words"] * 20)
    for inside in ("<dt>a<dd>b" * 200, "<table>" + "<tr><td>a<td>b" * 200 + "</table>", "<b>x" * 200, "<ul>" + "<li><i>x" * 200 + "</ul>"):
        for name in ("nav", "aside", "form"):
            assert html.main_text(f"<div><{name}>{inside}</{name}></div>{after}", {}) == want


def test_implied_ends_stay_inside_their_table_or_list():
    zones = lambda page: {v: z for kind, v, z, _, _ in html.items(page) if kind == "text"}
    assert zones("<table><tr><td class=o>a<table><tr><td class=i>b<td>c</table>d<td>e</table>f") == {"a": "td o", "b": "td i", "c": "td o", "d": "td o", "e": "", "f": ""}
    assert zones("<dl><dt class=t>a<dd>b<dl><dt class=u>c</dl>d<dt>e</dl>") == {"a": "dt t", "b": "", "c": "dt u", "d": "", "e": ""}


def test_long_class_lists_are_read_whole():
    many = " ".join(f"a{i}-utility" for i in range(30))
    after = "<p>" + "many good words " * 20 + "</p>"
    for word in ("widget", "sidebar", "related", "subscribe"):
        assert html.main_text(f"<div class='{many} {word}'>" + "buy this now " * 3 + f"</div>{after}", {}) == " ".join(["many good words"] * 20)
    keys = {z for page in (f"<div class='{many} x'>a", f"<div class='{many} y'>a") for _, v, z, _, _ in html.items(page) if v == "a"}
    assert len(keys) == 2 and all(len(k) <= html.LONG_ZONE for k in keys)
