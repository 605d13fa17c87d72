import hashlib

import numpy as np
import pytest

from gramlode.llm import fingerprint as f


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(0)
    for n, m, common in ((0, 0, 0), (0, 0, 50), (3, 0, 10), (40, 25, 7), (900, 800, 500)):
        keys = rng.integers(0, 2**63, n + m + common, dtype=np.uint64)
        both, a, b = keys[:common], keys[common : common + n], keys[common + n :]
        got, pair, sign = f.differences([np.r_[both, a]], [np.r_[both, b]])
        assert set(got[sign > 0]) == set(a) and set(got[sign < 0]) == set(b) and not pair.any()


def test_a_small_sketch_gets_stuck():
    s = f.Sketches(np.array([2]))
    keys = np.arange(50, dtype=np.uint64)
    s.add(keys, np.zeros(50, np.int64), np.ones(50, np.int64))
    assert not s.peel()[3][0]


def like(a, b):
    a, b = set(f.digests(a).tolist()), set(f.digests(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("rows_a_bucket", [4096, 20])
def test_versions(docs, no_docs, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(f, "ROWS_A_BUCKET", rows_a_bucket)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        want.append((i is None, i or 0, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(text, edited), 9), round(like(text, after), 9)))
    got = f.versions(docs).collect()
    assert sorted(want) == sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    text = {r[0]: r[1] for r in rows}
    assert len({(text[r.doc_id], bytes(r.sketch)) for r in got}) == len({text[r.doc_id] for r in got})
    assert f.versions(no_docs).count() == 0
