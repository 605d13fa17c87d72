import random

import xxhash

from gramlode.llm import simhash


def plain(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprints_and_groups(docs):
    prints = simhash.fingerprints(docs)
    rows = docs.collect()
    got = simhash.grouped(prints).collect()
    want = {}
    fps = [plain(r.text) for r in rows]
    root = classes(fps, 4)
    for r, c in zip(rows, root):
        ids = [x.doc_id for x, d in zip(rows, root) if d == c and x.doc_id is not None]
        want.setdefault(r.doc_id, set()).add(((plain(r.text)), min(ids) if ids else None))
    assert len(got) == len(rows)
    assert {k: v for k, v in want.items()} == {
        k: {(r.fp % 2**64, r.component_id) for r in got if r.doc_id == k} for k in {r.doc_id for r in got}
    }


def test_links_find_every_group_whatever_the_part_size(spark, monkeypatch):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 30)):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    want = classes(fps, 4)
    for part in (4096, 7):
        monkeypatch.setattr(simhash, "PART", part)
        root = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.linked(frame)).collect()}
        got = [root.get(f, f) for f in fps]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_one_of_each_group_stays(docs, no_docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    root = classes([plain(r.text) for r in rows], 4)
    order = lambda i: (i is None, i or 0)
    want = [min((r.doc_id for r, own in zip(rows, root) if own == g), key=order) for g in set(root)]
    assert sorted((r.doc_id for r in kept.collect()), key=order) == sorted(want, key=order)
    assert simhash.one_of_each(no_docs).count() == 0
    assert simhash.grouped(simhash.fingerprints(no_docs)).count() == 0
