"""Main text of web pages as the maximum-scoring stretch of the page.

A page is a sequence of words and tags. Words count as the element they stand in says (an unknown element: plus one
half), tags count against. Both weights are log-odds of standing inside or outside the main text, counted over labelled
pages: those whose publisher marked it with an ``article`` element. One linear scan finds the contiguous stretch with
the largest sum; elements inside it that are not text (forms, notices, comments ...) are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are counted over: the first by a hash of their address.
LABELLED = 4000
#: Weights kept, the most frequent elements and tags first.
MOST_WEIGHTS = 2000
UNKNOWN_WORD, UNKNOWN_TAG = 0.5, 1.0
#: Characters of a zone that stay as they are.
LONG_ZONE = 80
#: What each word and tag inside an element that is not text counts against a stretch that crosses it.
ASIDE_COST = 0.1

_ITEM = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements and words in class, id or role that name what is not main text.
ASIDE = frozenset("nav aside footer form button select menu dialog head".split())
ASIDE_WORDS = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment-?list|respond|reply|replies|consent|cookies?|disclaimer|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo\w*|related|recommended|share|sharing|sidebar|social|sponsor\w*|subscribe|teaser|toolbar|widget)(?:$|[-_\s\d])",
    re.I,
)


#: Elements that an opening tag ends (innermost of each name), unless one of the others was opened since.
_BARS = BLOCKS - {"address", "div", "p", "dt", "dd", "li"}
_SECTIONS = frozenset("tbody thead tfoot caption colgroup".split())
ENDS = {
    "li": (("li",), _BARS),
    "dt": (("dt", "dd"), _BARS),
    "dd": (("dt", "dd"), _BARS),
    "td": (("td", "th"), frozenset({"tr", "table"})),
    "th": (("td", "th"), frozenset({"tr", "table"})),
    "tr": (("td", "th", "tr", "caption", "colgroup"), frozenset({"table", "tbody", "thead", "tfoot"})),
    **{x: (("td", "th", "tr", *sorted(_SECTIONS)), frozenset({"table"})) for x in ("tbody", "thead", "tfoot")},
}


def _zone(name: str, attrs: str) -> str | None:
    """What an element says about its words: its name, with all words of its class, id and role; None if nothing."""
    if "=" in attrs:
        words = " ".join(sorted({w.lower() for m in _NAMED.findall(attrs) for w in "".join(m).split()}))
        if words:
            return f"{name} {words}"
    return name if name in ASIDE or name in ("header", "article", "main") else None


def _key(zone: str) -> str:
    """A zone as the weights know it: a long one by its hash."""
    return zone if len(zone) <= LONG_ZONE else f"{zone.split()[0]} #{xxhash.xxh64_hexdigest(zone.encode('utf-8', 'replace'))}"


def _is_aside(name: str, zone: str | None, in_article: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_article):
        return True
    return zone is not None and name not in ("article", "main", "body", "html") and bool(ASIDE_WORDS.search(zone[len(name) :]))


def items(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """``kind, value, zone, aside, article`` of each word run (kind "text") and tag ("open", "close") in page order.

    ``zone`` is that of the innermost element that has one; ``aside`` and ``article`` say whether any open element is of
    that kind. Closing tags close up to the element they name, or nothing; cells, rows and list entries end as HTML implies. Scripts, styles and the like are one tag.
    """
    open_: list[tuple[str, str, bool, bool]] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name, the innermost last
    zone, aside, article = "", False, False

    def close(i: int) -> tuple[str, bool, bool]:
        for x in open_[i:]:
            places[x[0]].pop()
        state = open_[i][1:]
        del open_[i:]
        return state

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    for m in _ITEM.finditer(page):
        text = m["text"]
        if text is not None:
            if text != "<" or m.end() < len(page):
                yield "text", text, zone, aside, article
            continue
        name = (m["name"] or m["raw"] or "!").lower()
        if m["name"] is None:
            yield "open", name, zone, aside, article
        elif not m["close"]:
            yield "open", name, zone, aside, article
            if name in VOID or m["attrs"].endswith("/"):
                continue
            if name in ENDS and open_:
                ended, bars = ENDS[name]
                bar = max(map(last, bars))
                found = [i for i in map(last, ended) if i > bar]
                if found:
                    zone, aside, article = close(min(found))
            elif name in ("p", "option") and open_ and open_[-1][0] == name:
                zone, aside, article = close(len(open_) - 1)
            own = _zone(name, m["attrs"])
            places[name].append(len(open_))
            open_.append((name, zone, aside, article))
            aside = aside or _is_aside(name, own, article)
            zone, article = _key(own) if own is not None else zone, article or name == "article"
        else:
            yield "close", name, zone, aside, article
            if last(name) >= 0:
                zone, aside, article = close(last(name))


def counted(page: str) -> Counter:
    """``(key, inside) -> n`` over the words (key "w" + zone) and tags (key "t" + name) of one labelled page."""
    out: Counter = Counter()
    for kind, value, zone, aside, article in items(page):
        if kind == "text":
            n = len(value.split())
            if n:
                out["w" + zone, article and not aside] += n
        else:
            out["t" + value, article and not aside] += 1
    return out


def _count_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for page in batch.column(0):
            total.update(counted(page.as_py()))
    keys = list(total)
    yield pa.record_batch(
        [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
        ["key", "inside", "n"],
    )


def learned(pages: DataFrame, labelled: int = LABELLED) -> dict[str, float]:
    """Weights by key, from at most ``labelled`` pages with an article element. Without such pages there are none, and
    the defaults for unknown words and tags hold."""
    marked = pages.where(F.col("html").rlike(r"(?i)<article[\s>]")).select("html", F.xxhash64("url", "html").alias("at"))
    # only hashes are ordered; equal pages count once
    chosen = marked.select("at").distinct().orderBy("at").limit(labelled)
    sample = marked.join(F.broadcast(chosen), "at").dropDuplicates(["at"]).select("html")
    counts = sample.mapInArrow(_count_pages, "key string, inside boolean, n long").groupBy("key").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n")
    )
    rows = counts.orderBy(F.desc("n"), "key").limit(MOST_WEIGHTS).collect()
    odds = {r.key: math.log((r.inside + 0.5) / (r.n - r.inside + 0.5)) for r in rows}
    bound = lambda x, low, high: min(max(x, low), high)
    # a word scores up to one either way; a tag counts against wherever it stands, less so where main text has it
    return {k: bound(x / 2, -1.0, 1.0) if k[0] == "w" else 0.5 + bound(-x / 4, 0.0, 1.5) for k, x in odds.items()}


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch ``[begin, end)`` with the largest sum; the first if there are several; empty if none is
    positive."""
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, best_at = total, (begin, i + 1)
    return best_at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page: blocks in page order, one a line, white space inside a block turned into one space."""
    if not page:
        return ""
    seq = list(items(page))
    scores = []
    for kind, value, zone, aside, _ in seq:
        if aside:  # left out of any stretch, so that it only has to keep two texts apart
            scores.append(-ASIDE_COST * (len(value.split()) if kind == "text" else 1))
        elif kind == "text":
            scores.append(len(value.split()) * weights.get("w" + zone, UNKNOWN_WORD))
        else:
            scores.append(-weights.get("t" + value, UNKNOWN_TAG))
    begin, end = best_stretch(scores)
    blocks, held = [], []
    for kind, value, _, aside, _ in seq[begin:end]:
        if kind == "text":
            if not aside:
                held.append(value)
        elif value in BLOCKS:
            blocks.append("".join(held))
            held = []
        elif value == "br":
            held.append(" ")
    blocks.append("".join(held))
    return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text`` of every row. Null or empty html gives an empty text, as does a page without any stretch
    of words that outweighs its tags; null ids and addresses stay null; repeated rows give equal texts."""
    weights = learned(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py(), weights) for p in batch.column(2)], pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
