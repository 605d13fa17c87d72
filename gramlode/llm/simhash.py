"""SimHash near-duplicates through BK-trees.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Different fingerprints that
differ in at most ``radius`` bits agree on some of the blocks that the 64 bits are cut into, so they meet in the shard
of that agreement. In a shard the fingerprints form a BK-tree, children keyed by their distance to the parent; a search
follows only edges within the radius. Trees travel to just those tasks whose fingerprints can match, because neither
one tree nor all of them have a bounded size. A shard gives a spanning forest of its links, not all its pairs; the
links' connected components are the groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import give_back
from gramlode.llm.tokens import mixed
from gramlode.session import stored

SHINGLE, RADIUS = 4, 4
BITS = 64
#: Hashes unpacked at once.
_CHUNK = 1 << 16
#: Fingerprints of a shard that one search handles; a larger shard is dealt out as pairs of such parts.
PART = 4096


def fingerprint(text: bytes, words: int = SHINGLE, bits: int = BITS) -> int:
    """The fingerprint of one UTF-8 text, unsigned: A-Z lower-cased, words between ASCII white space. Bits beyond the
    first 64 come from further hashes of the shingles' hashes."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    space = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begin, end = np.r_[0, space + 1].tolist(), np.r_[space, len(joined)].tolist()
    size = max(1, len(tokens) - words + 1)
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    spans = zip(begin[:size], end[min(words, len(tokens)) - 1 :])
    counts = np.zeros(bits, np.int64)
    while True:
        h = np.fromiter((hashed(joined[a:b]) for a, b in itertools.islice(spans, _CHUNK)), ">u8")
        if not len(h):
            break
        for lane in range(bits // 64):
            x = h if lane == 0 else mixed(h.astype(np.uint64) + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)).astype(">u8")
            counts[64 * lane : 64 * lane + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > size).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in column), np.uint64, len(column))
            yield pa.record_batch([*batch.columns[:-1], pa.array(fp.view(np.int64))], [*batch.schema.names[:-1], "fp"])
        give_back()

    return run


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE, keep: str = "doc_id") -> DataFrame:
    """``keep`` (as long) and ``fp`` (the fingerprint's bits as a long) of every row."""
    rows = docs.select(F.col(f"`{keep}`").cast("long").alias(keep), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(words), f"{keep} long, fp long")


def _cut(radius: int, distinct: int) -> tuple[list[int], int]:
    """Widths of the blocks, and how many of them agree between any two fingerprints within the radius: as few shards as
    keep the expected shard small."""
    for agree in range(1, 5):
        widths = [len(x) for x in np.array_split(np.arange(BITS), radius + agree)]
        if 2 ** sum(sorted(widths)[:agree]) >= distinct:
            break
    return widths, agree


def _shards(fp: Column, radius: int, distinct: int) -> Column:
    """The shards of a fingerprint: one for each choice of agreeing blocks, keyed by the choice and the blocks' bits."""
    widths, agree = _cut(radius, distinct)
    starts = [sum(widths[:i]) for i in range(len(widths))]
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(len(widths)), agree)):
        mask = sum(((1 << widths[i]) - 1) << starts[i] for i in chosen)
        signed = mask - 2**64 if mask >= 2**63 else mask
        keys.append(F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


class BKTree:
    """Nodes in arrays; the children of a node are keyed by their distance to it."""

    def __init__(self, first: int) -> None:
        self.values, self.children = [first], [{}]

    def add(self, value: int) -> None:
        at = 0
        while True:
            d = (value ^ self.values[at]).bit_count()
            if d == 0:
                return
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` away."""
        out, open_ = [], [0]
        while open_:
            at = open_.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                out.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                open_ += [n for e, n in children.items() if d - radius <= e <= d + radius]
            else:
                open_ += [children[e] for e in range(max(1, d - radius), d + radius + 1) if e in children]
        return out


class Pool:
    """Fingerprints that no link has reached yet, in a tree that is built anew when half of it is taken."""

    def __init__(self, values: list[int]) -> None:
        self.values, self.free, self.left = values, [True] * len(values), len(values)
        self._grow(range(len(values)))

    def _grow(self, places) -> None:
        self.places = list(places)
        self.tree = BKTree(self.values[self.places[0]]) if self.places else None
        for i in self.places[1:]:
            self.tree.add(self.values[i])

    def take(self, i: int) -> None:
        self.free[i] = False
        self.left -= 1

    def take_near(self, value: int, radius: int) -> list[int]:
        """Take all within the radius."""
        if not self.left:
            return []
        if 2 * self.left < len(self.places):
            self._grow(i for i in self.places if self.free[i])
        found = [i for i in (self.places[n] for n in self.tree.within(value, radius)) if self.free[i]]
        for i in found:
            self.take(i)
        return found


def links(tree: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the distinct fingerprints ``tree`` and ``queries``, and inside ``tree``
    when both are the same list: positions in ``queries`` and in ``tree``.

    Links are followed from one fingerprint to those that none has reached yet, so that a dense group is taken at once
    instead of being searched once for each member.
    """
    out, same = [], tree is queries
    if len(tree) <= 3 or len(queries) <= 1:  # too few for a tree to pay
        for i, a in enumerate(queries):
            out += [(i, j) for j in range(i + 1 if same else 0, len(tree)) if (a ^ tree[j]).bit_count() <= radius]
        return out
    pools = [Pool(tree)]
    pools.append(pools[0] if same else Pool(queries))
    for start in range(len(tree)):
        if not pools[0].free[start]:
            continue
        pools[0].take(start)
        reached = [(0, start)]
        while reached:
            side, i = reached.pop()
            other = 1 - side
            for j in pools[other].take_near((tree, queries)[side][i], radius):
                out.append((j, i) if side == 0 else (i, j))
                reached.append((other, j))
    return out


def _link_shards(radius: int):
    """Sorted rows ``choice, bits, part, other, side, fp, wide``: groups of equal first four columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        sides: tuple[list, list] = ([], [])
        found: list[tuple[int, int]] = []

        def close() -> None:
            if key is None or not sides[0]:
                return
            tree, queries = (sides[0], sides[0]) if key[2] == key[3] else sides
            if len(tree) > 1 or tree is not queries:
                values = [w for _, w in tree]
                pairs = links(values, values if tree is queries else [w for _, w in queries], radius)
                found.extend((queries[i][0], tree[j][0]) for i, j in pairs)

        def out() -> pa.RecordBatch:
            pairs = np.array(found, np.int64).reshape(-1, 2)
            found.clear()
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            wide = [int.from_bytes(w, "big") for w in batch.column(6).to_pylist()]
            for choice, bits, part, other, side, fp, w in zip(*(c.to_pylist() for c in batch.columns[:6]), wide):
                if (choice, bits, part, other) != key:
                    close()
                    key, sides = (choice, bits, part, other), ([], [])
                sides[side].append((fp, w))
            if len(found) >= 1 << 16:
                yield out()
        close()
        if found:
            yield out()

    return run


def _dealt(shards: DataFrame) -> DataFrame:
    """Rows ``choice, bits, fp, ...`` with the parts of their shard that meet: ``choice, bits, part, other, side, fp, ...``,
    equal first four columns together."""
    # only shards above the size of a part need to be known by their size
    large = stored(
        shards.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART), "simhash-large"
    )
    parts = F.coalesce(F.ceil(F.col("n") / PART), F.lit(1)).cast("int")
    sized = shards.join(large, ["choice", "bits"], "left").withColumn("parts", parts)
    # parts of a shard meet in pairs; the part that comes first brings the tree, the other one the queries
    meetings = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(
            F.least(F.col("own"), o).alias("part"), F.greatest(F.col("own"), o).alias("other"), (F.col("own") > o).cast("int").alias("side")
        ),
    )
    rest = shards.columns[2:]
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).select("choice", "bits", F.explode(meetings).alias("m"), *rest)
    dealt = dealt.select("choice", "bits", "m.part", "m.other", "m.side", *rest)
    return dealt.repartition("choice", "bits", "part", "other").sortWithinPartitions("choice", "bits", "part", "other")


def _linked(shards: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` between the ``fp`` of rows ``choice, bits, fp, wide`` that share a shard (``choice, bits``) and
    whose ``wide`` bits are within the radius: at least a spanning forest of every group that is connected so."""
    return _dealt(shards).mapInArrow(_link_shards(radius), "a long, b long").distinct()


def linked(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links of different fingerprints ``fp`` of 64 bits within the radius, none between groups that should be apart and
    at least a spanning forest of every connected group."""
    shards = distinct.select("fp", F.explode(_shards(F.col("fp"), radius, distinct.count())).alias("s"))
    wide = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    return _linked(shards.select("s.choice", "s.bits", "fp", wide.alias("wide")), radius)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges (a, b)``, the root being the smallest node it is connected to.

    Alternates hooking every node's larger neighbours, then its smaller ones, to its smallest neighbour until nothing
    changes; neighbourhoods are aggregated to their minimum, never collected.
    """
    edges = stored(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
    size = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select(F.col("m").alias("u"), "v").union(small.select(F.col("m").alias("u"), F.col("u").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == size:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        size = state


def grouped(prints: DataFrame, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """``key, fp, component_id`` of every row of ``prints (key, fp)``: the smallest key among the rows that are linked to
    it through fingerprints within the radius, itself included. Rows with equal fingerprints are linked; rows without key
    link others but give no component id, which is null where no row of the group has a key."""
    lowest = stored(prints.groupBy("fp").agg(F.min(key).alias("low")), "simhash-distinct")
    roots = components(linked(lowest.select("fp"), radius))
    named = lowest.join(roots, lowest.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = named.join(ids, "root").select("fp", "component_id")
    return prints.join(of_print, "fp", "left").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group of ``docs``: that with the smallest ``doc_id``, null last, then by a hash of the row.

    Groups are those of ``grouped``: fingerprints of shingles of ``words`` words, linked at ``radius`` or fewer differing
    bits. A null, empty or blank text has fingerprint zero and is linked like any other. Of rows that are equal in every
    column one stays. Columns, whatever their names, and their order stay as they are; no rows give no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("doc"), F.xxhash64(*columns).alias("row"))
    named = rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "row", F.col("doc.text").cast("string").alias("text"))
    prints = stored(named.mapInArrow(_fingerprints(words), "doc_id long, row long, fp long"), "simhash")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    lowest = stored(prints.groupBy("fp").agg(F.min(rank).alias("low")), "simhash-distinct")
    roots = components(linked(lowest.select("fp"), radius))
    groups = lowest.join(roots, lowest.fp == roots.node, "left").select("low", F.coalesce("root", "fp").alias("root"))
    kept = groups.groupBy("root").agg(F.min("low").alias("low")).select("low.row").distinct()
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
