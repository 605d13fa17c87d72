"""Secret scans with multipart credential linking.

Some credentials are plain by themselves: assigned secrets, access ids, long hexadecimal keys. Others are weak alone (a
login name, a random-looking word, an address) and are reported only where the parts that complete them co-occur: an
identifier with a secret, an endpoint with both. Every part is an interval of its text, widened by ``reach`` within its
scope; scopes are blocks between blank lines. The join of parts by overlapping intervals runs as one merge over sorted
ends and begins of all parts of a slice of rows: a part looks at its nearest neighbours only, so that a text with very
many parts gives no pairs, and neither texts nor parts leave their task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import byte_slices

#: The kinds reported without further conditions, and the least length of what they must hold.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Parts that are weak alone: a named identifier; a named secret of any length or a random-looking word of 20 or more
#: characters with capitals, small letters and digits; an address by its scheme or its name.
IDENTIFIER = r"""(?:access_?key_?id|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})"""
SECRET = r"""(?:password|passwd|passphrase|pass|pwd|secret|token|credential|api_?key|private_?key)["']?\x20*[:=]\x20*["']?([^\s"',;]{4,})"""
RANDOM = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.:-]{3,})"""
#: An address that carries its own name and password.
WITH_LOGIN = r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>/:@]+:[^\s"'<>/@]+@"""
BLANK_LINE = r"\n[\x20\x09\x0D]*\n"

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = 3  # so many kinds are reported whatever stands near them
#: Code points between the parts of one credential, at most.
REACH = 200
SLICE_BYTES = 4 << 20
#: What each kind is part of a credential as: 0 identifier, 1 secret, 2 endpoint.
ROLE = np.array([1, 0, 1, 0, 1, 2])

_any_case = {name: re.compile(p, re.IGNORECASE | re.ASCII) for name, p in (("assign", ASSIGN), ("identifier", IDENTIFIER), ("secret", SECRET), ("endpoint", ENDPOINT), ("login", WITH_LOGIN))}
_access, _hex, _random, _blank = (re.compile(p) for p in (ACCESS, rf"[0-9a-f]{{{LEAST['hex']},}}", RANDOM, BLANK_LINE))


class Part(NamedTuple):
    begin: int
    kind: int  # place in KINDS
    end: int
    whole: bool = False  # a weak part that needs no other


def base_parts(text: str) -> list[Part]:
    """The parts reported by themselves."""
    found = [
        Part(m.start(), 0, m.end()) for m in _any_case["assign"].finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]
    ]
    found += [Part(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [Part(m.start(), 2, m.end()) for m in _hex.finditer(text)]


def _looks_random(word: str) -> bool:
    return any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)


def weak_parts(text: str, base: list[Part]) -> list[Part]:
    """The parts that may belong to a credential, without those that overlap a reported or an earlier kind's part.

    No secret completes anything without an identifier near it, so the other kinds are looked for only where there is one.
    """
    names = [Part(m.start(1), 3, m.end(1)) for m in _any_case["identifier"].finditer(text)]
    logins = {m.start() for m in _any_case["login"].finditer(text)} if "://" in text else set()
    if not names and not logins and not any(p.kind == 1 for p in base):
        return []
    found = names + [Part(m.start(1), 4, m.end(1)) for m in _any_case["secret"].finditer(text)]
    found += [Part(m.start(), 4, m.end()) for m in _random.finditer(text) if _looks_random(m[0])]
    for m in _any_case["endpoint"].finditer(text):
        begin, end = m.span(1) if m[1] else m.span()
        found.append(Part(begin, 5, end, begin in logins))
    return _apart(found, base)


def _apart(found: list[Part], taken: list[Part]) -> list[Part]:
    """Those that overlap none of ``taken`` and none of a kind before theirs (of one kind: none that begins earlier)."""
    kept: list[Part] = []
    for kind in range(BASE, len(KINDS)):
        held = sorted([*taken, *kept])
        begins = [p.begin for p in held]
        ends = np.maximum.accumulate([p.end for p in held]) if held else np.zeros(0, np.int64)
        last = -1
        for part in sorted({p for p in found if p.kind == kind}):
            before = int(np.searchsorted(begins, part.end))  # those that begin ahead of its end
            if part.begin >= last and (not before or ends[before - 1] <= part.begin):
                kept.append(part)
                last = part.end
    return kept


class Near(NamedTuple):
    gap: np.ndarray
    begin: np.ndarray


def nearest(begin: np.ndarray, end: np.ndarray, of: np.ndarray) -> Near:
    """For every interval, the gap to the nearest of those chosen by ``of`` (0: they overlap) and where that one begins.

    A merge: among the chosen that begin no later, the one that reaches farthest is nearest; else the next to begin.
    """
    far = np.iinfo(np.int64).max // 2
    chosen = np.flatnonzero(of)
    chosen = chosen[np.argsort(begin[chosen], kind="stable")]
    if not len(chosen):
        return Near(np.full(len(begin), far), np.zeros(len(begin), np.int64))
    begins, ends = begin[chosen], end[chosen]
    reach = np.maximum.accumulate(ends)
    farthest = np.maximum.accumulate(np.where(ends == reach, np.arange(len(ends)), 0))
    next_at = np.searchsorted(begins, begin, "right")
    has_before, has_after = next_at > 0, next_at < len(begins)
    before = farthest[np.maximum(next_at - 1, 0)]
    after = np.minimum(next_at, len(begins) - 1)
    gap_before = np.where(has_before, np.maximum(begin - ends[before], 0), far)
    gap_after = np.where(has_after, np.maximum(begins[after] - end, 0), far)
    return Near(np.minimum(gap_before, gap_after), np.where(gap_before <= gap_after, begins[before], begins[after]))


def link(parts: list[list[Part]], cuts: list[list[int]], sizes: list[int], reach: int = REACH) -> list[list[tuple[Part, int | None]]]:
    """The reported parts of every text in order, weak ones with the begin of the nearest part that completes them.

    ``cuts``: where blank lines begin. All texts lie behind one another on one line, more than ``reach`` apart, and so do
    their scopes; intervals are then near each other only within a scope.
    """
    flat = [p for own in parts for p in own]
    if not flat:
        return [[] for _ in parts]
    begin, kind, end, whole = (np.array(x, np.int64) for x in zip(*flat))
    text = np.repeat(np.arange(len(parts)), [len(own) for own in parts])
    scope = np.concatenate([np.searchsorted(c, [p.begin for p in own], "right") for own, c in zip(parts, cuts) if own])
    room = np.array(sizes, np.int64) + (np.array([len(c) for c in cuts], np.int64) + 1) * (reach + 1)
    shift = (np.cumsum(room) - room)[text] + scope * (reach + 1)
    to = [nearest(begin + shift, end + shift, ROLE[kind] == role) for role in (0, 1)]
    named, secret = (near.gap <= reach for near in to)
    role = ROLE[kind]
    stays = (kind < BASE) | (whole > 0) | np.choose(role, [secret, named, named & secret])
    partner = np.where(role == 1, to[0].begin, to[1].begin) - shift
    out: list[list[tuple[Part, int | None]]] = [[] for _ in parts]
    for i in np.flatnonzero(stays).tolist():
        out[text[i]].append((flat[i], None if flat[i].kind < BASE or whole[i] else int(partner[i])))
    return [sorted(own, key=lambda x: (x[0].begin, x[0].kind, x[0].end)) for own in out]


SPANS = "array<struct<kind string, begin long, end long, partner long>>"


def _scan(reach: int):
    spans = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("partner", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in byte_slices(batch, 1, SLICE_BYTES)):
            texts = [t or "" for t in part.column(1).to_pylist()]
            parts, cuts = [], []
            for text in texts:
                base = base_parts(text)
                weak = weak_parts(text, base)
                parts.append(base + weak)
                cuts.append([m.start() for m in _blank.finditer(text)] if weak else [])
            found = link(parts, cuts, list(map(len, texts)), reach)
            rows = [[{"kind": KINDS[p.kind], "begin": p.begin, "end": p.end, "partner": to} for p, to in own] for own in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(spans))], ["key", "spans"])

    return run


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """``key, spans`` of every row: ``kind, begin, end, partner`` of the spans in order of begin and kind, in code points,
    the end exclusive. ``partner``: where the nearest part that completes a weak one begins, null for the others.

    A null or empty text has no spans. Ids are kept as they are, null ones too; repeated rows give equal rows; no rows
    give no rows. Other columns are not looked at. Of equally near parts the earlier one is the partner.
    """
    chosen = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(_scan(reach), f"key long, spans {SPANS}")
