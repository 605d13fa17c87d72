import hashlib
from collections import Counter

import pytest

from gramlode.llm import alignment

ODD = ["", None, " ", "a  b", " x ", "x \n y", "▁ab c", "ok <|endoftext|> <s> it's 12", "ＡＢ c", "a\x00 b", "\x1c a", "tail ", "日本 語 x", "ab" * 3000 + " b", "　a b   c"]


@pytest.fixture(scope="module")
def plain(texts):
    """Both tokenizers on whole texts, and shared ends by plain search."""
    aligner = alignment._aligner(*alignment.default_paths())

    def one(text):
        if not text:
            return [], [], [], []
        a = aligner.a.encode(" " + text, add_special_tokens=False).ids
        b = aligner.b.encode(text)
        pieces = [[of[i] for i in ids] for of, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b))]
        if any(b"".join(p) != (" " + text).encode() for p in pieces):
            return [], [], [], []
        ends = [[], []]
        for side in (0, 1):
            at = 0
            for piece in pieces[side]:
                at += len(piece)
                ends[side].append(at)
        where = {end: j for j, end in enumerate(ends[1])}
        groups, links, i, j = [], [], 0, 0
        for k, end in enumerate(ends[0]):
            if end in where:
                m = where[end]
                links.append((a[k], b[m]))
                groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
                i, j = k + 1, m + 1
        return a, b, groups, links

    return one


def test_against_whole_texts(spark, texts, plain):
    rows = list(enumerate([*texts, *ODD, *ODD[:4]])) + [(None, "no id at all"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_a", "2 as key", "'x' as groups")
    found = alignment.linked_corpus(docs, digests=False).collect()
    expected = [(i, plain(t)) for i, t in rows]
    counts = Counter(link for _, (_, _, _, links) in expected for link in links)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))

    def row(i, a, b, groups, links):
        best = sum(counts[link] == highest[link[1]] for link in links)
        return i, len(a), len(b), len(groups), ";".join(groups), len(links), best, sum(counts[link] for link in links)

    order = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found), key=order) == sorted((row(i, *x) for i, x in expected), key=order)
    digests = {r.key: r.groups for r in alignment.linked_corpus(docs).collect()}
    for i, (_, _, groups, _) in expected[: len(texts)]:
        assert digests[i] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


def test_full_memory_changes_nothing(texts, monkeypatch):
    large = alignment._aligner(*alignment.default_paths())
    monkeypatch.setattr(alignment, "MEMO_CHARS", 10)
    monkeypatch.setattr(alignment, "MEMO_BYTES", 10)
    forgetful = alignment.Aligner(*alignment.default_paths())
    for _ in range(2):
        one, other = large.align(texts), forgetful.align(texts)
        assert one[2] == other[2] and all((x == y).all() for x, y in zip((one[0], one[1], one[3], one[4]), (other[0], other[1], other[3], other[4])))


def test_possible_pairs_and_letters():
    assert alignment.possible_pairs([b"a", b"ba", b""], [b"a", b"cba", b"b"]).tolist() == [0, 1, 3, 4]
    letters = alignment.byte_letters()
    assert len(set(letters.values())) == 256 and letters["Ġ"] == 32 and letters["a"] == 97


def test_no_rows(spark, no_docs):
    assert alignment.linked_corpus(no_docs).count() == 0


def test_token_bytes(spark):
    aligner = alignment._aligner(*alignment.default_paths())
    text = "Il était une fois 12,5"
    ids = [aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)]
    frame = spark.createDataFrame([tuple(ids)], "a array<int>, b array<int>")
    row = frame.select(alignment.token_bytes(True, frame.a).alias("a"), alignment.token_bytes(False, frame.b).alias("b")).first()
    assert bytes(row.a) == bytes(row.b) == (" " + text).encode()


def test_windows_are_named_from_the_vocabularies():
    """Ids are not turned into text for every occurrence: the names are made once per vocabulary."""
    aligner = alignment.Aligner(*alignment.default_paths())
    before = aligner.align(["one word and another, überaus 12345", "one"])[2]
    aligner.forget_windows()
    aligner.names_a = [f"a{i}" for i in range(len(aligner.bytes_a))]
    aligner.names_b = [f"b{i}" for i in range(len(aligner.bytes_b))]
    named = aligner.align(["one word and another, überaus 12345", "one"])[2]
    assert named != before and [g.replace("a", "").replace("b", "") for g in named] == before
