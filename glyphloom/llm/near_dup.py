"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, connected components.

A document's set holds the 64-bit hashes of its distinct five-word shingles (words: runs of anything but the six ASCII white
spaces, A-Z in lower case; with fewer words the whole sequence is one shingle). SuperMinHash gives each element one register
a level, by a Fisher-Yates shuffle of its own, with rank plus a uniform fraction as the value. A level can only lower
registers that hold at least its number, so all levels after the first that every register lies under are skipped.

Equal sets form a class; only a class's smallest document goes on. Bands put classes in buckets. In a bucket every member
is held against the leader (its smallest member), then those outside its component against TARGETS more members. Every pair
of a bucket that the components still don't join is held against each other too, unless its parities rule it out or too few
of its registers agree in four bits; so no candidate pair goes untested but those whose answer cannot change a
component. Verification intersects the full sets.

The parities of a set are PARITIES bits, each saying whether an odd number of elements hash to it. Where those of two sets
differ there is an element in only one of them, so the number of differing bits never exceeds the symmetric difference, and a
pair with more than its similarity allows is no link for certain.

The share that links is a parameter of ``components`` and ``one_of_each``; bands and registers follow from it (``Plan``). At 0.85
a pair at that similarity shares no bucket with probability (1 - 0.85^ROWS)^bands, 4e-7, and has fewer registers alike than are
asked for with 3e-8; at other shares the bounds are MISSED and UNLIKE.

Defined cases: a document without words (null, empty or white space) has an empty set, is its own component and kept; equal
rows are one class; rows that share a doc_id count as linked; a row without doc_id is linked with nothing, has no component_id and is
kept; an empty table gives no rows; other columns are ignored by ``components`` and kept by ``one_of_each``. "Full sets" are sets of
64-bit hashes, so two different shingles of one pair of documents pass for one with a chance of about their number's square in 2^64.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm.shared import Tidy, materialise, release, text_rows

ROWS = 5
SHINGLE = 5
MIN_SHARE = 85  # of a hundred
MISSED, UNLIKE = 5e-7, 3e-8
TARGETS = 4
PARITIES = 1024  # bits
BROADCAST_IDS = 1_000_000  # 8 MB of ids; beyond that they are shuffled

_G = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_COLUMN = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Plan:
    """What follows from the share of a hundred that links: bands, registers, and how many of these a link has alike."""

    share: int

    @property
    def bands(self) -> int:
        return max(1, math.ceil(math.log(MISSED) / math.log1p(-((min(self.share, 99) / 100) ** ROWS))))

    @property
    def registers(self) -> int:
        return self.bands * ROWS

    @property
    def alike(self) -> int:
        """The largest number that a pair at the share stays below with at most UNLIKE."""
        p = min(self.share, 99) / 100
        n, p, tail = self.registers, p + (1 - p) / 16, 0.0  # different registers have the same four bits once in 16
        for k in range(n):
            tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if tail > UNLIKE:
                return k
        return n


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), 0xD6E8FEB86659FD93, np.uint64))))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    sizes = ends - starts
    inside = np.flatnonzero(~space)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    words = mix(np.add.reduceat(_BYTE[data[inside]] * _powers(int(sizes.max()))[place], first) + sizes.astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    full = mix(sum(words[i : len(words) - SHINGLE + 1 + i] * _PLACE[i] for i in range(SHINGLE))) if len(words) >= SHINGLE else words[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(full[a : b - SHINGLE + 1]))
        else:
            some = words[a:b]
            out.append(mix((some * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)) if b > a else some)
    return out


def signature(elements: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash of so many registers over distinct element hashes (at least one)."""
    n, registers = len(elements), np.full(size, np.inf)
    rows, places = np.arange(n), None
    for level in range(size):
        seed = elements + np.uint64(int(_G) * (2 * level + 1) & (1 << 64) - 1)
        value = (mix(seed) >> np.uint64(11)) * 2.0**-53 + level
        other = (mix(seed + _G) % np.uint64(size - level)).astype(np.int64) + level
        if level == 0:
            register, swap = other, other
        else:
            if places is None:
                places = np.broadcast_to(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (n, size)).copy()
                places[rows, 0], places[rows, swap] = places[rows, swap], places[rows, 0].copy()
            register = places[rows, other]
            places[rows, other] = places[:, level]
        np.minimum.at(registers, register, value)
        if registers.max() < level + 1:
            break
    return registers


def bands_of(registers: np.ndarray) -> np.ndarray:
    raw = mix(registers.view(np.uint64)).reshape(-1, ROWS)
    return mix((raw * _COLUMN).sum(1, dtype=np.uint64) + np.arange(len(raw), dtype=np.uint64) * _G).view(np.int64)


def nibbles_of(registers: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen registers a long."""
    four = np.zeros(-(-len(registers) // 16) * 16, np.uint64)
    four[: len(registers)] = mix(registers.view(np.uint64)) >> np.uint64(60)
    return (four.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)


def parities_of(elements: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements fall to each place, 64 places a long."""
    odd = np.bincount((mix(elements + _G) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(share: int, odd_one: str, odd_two: str, size_one: str, size_two: str) -> Column:
    """False only where the parities prove that the symmetric difference is too large."""
    least = F.lit(0)
    for i in range(PARITIES // 64):
        least = least + F.bit_count(F.col(odd_one)[i].bitwiseXOR(F.col(odd_two)[i]))
    return least * (100 + share) <= (100 - share) * (F.col(size_one) + F.col(size_two))


def _differing(registers: int, one: str, two: str) -> Column:
    """How many registers differ in their four bits."""
    total = F.lit(0)
    for i in range(-(-registers // 16)):
        x = F.col(one)[i].bitwiseXOR(F.col(two)[i])
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return total


_SKETCH = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("nibbles", pa.list_(pa.int64())), ("parities", pa.list_(pa.int64()))])


def _in_pieces(batch, most: int = 1 << 19):
    """(doc_id, UTF-8) lists of bounded size; a single text may exceed it."""
    ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        ids.append(doc_id)
        texts.append(text.as_py() or b"")
        held += len(texts[-1])
        if held >= most:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _sketch(registers: int) -> Callable:
    def sketch(batches):
        for batch in batches:
            for ids, texts in _in_pieces(batch):
                known: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
                keys, sizes, bands, nibbles, parities = [], [], [], [], []
                for doc_id, s in zip(ids, shingle_sets(texts), strict=True):
                    key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else struct.pack(">q", doc_id or 0)
                    if len(s) and key not in known:
                        own = signature(s, registers)
                        known[key] = (bands_of(own), nibbles_of(own), parities_of(s))
                    keys.append(key)
                    sizes.append(len(s))
                    bands.append(known[key][0] if len(s) else [])
                    nibbles.append(known[key][1] if len(s) else [])
                    parities.append(known[key][2] if len(s) else [])
                longs = [pa.array(x, pa.list_(pa.int64())) for x in (bands, nibbles, parities)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *longs], schema=_SKETCH)

    return sketch


def _sets(batches):
    for batch in batches:
        for ids, texts in _in_pieces(batch):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in shingle_sets(texts)], pa.list_(pa.int64()))], names=["node", "elements"])


def _verified(rows: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets share enough; written."""
    pairs = materialise(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = materialise(nodes, "pair-nodes")
    known = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    sets = materialise(rows.join(known, rows["doc_id"] == known["node"], "left_semi").mapInArrow(Tidy(_sets), "node long, elements array<long>"), "sets")
    one, two = sets.select(F.col("node").alias("b"), F.col("elements").alias("two")), sets.select(F.col("node").alias("a"), F.col("elements").alias("one"))
    both = pairs.join(one.hint("merge"), "b").join(two.hint("merge"), "a")
    shared = F.size(F.array_intersect("one", "two"))
    links = materialise(both.where(100 * shared >= share * (F.size("one") + F.size("two") - shared)).select("a", "b"), "links")
    for used in (pairs, nodes, sets):
        release(used)
    return links


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (a, b) with the smallest node it reaches.

    Large-star and small-star rounds until nothing changes. The neighbours' minimum is a partial aggregate, and what it
    is joined with is a written table, so that Spark can split the partition of a node with very many neighbours.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first())
    before = print_of(edges)
    while before[0]:
        both = materialise(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "neighbours")
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least2 = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least2.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(least2.select("u", F.col("m").alias("v")))
        after = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "small-star")
        for used in (both, least, large, least2):
            release(used)
        now = print_of(after)
        same = now == before and after.join(edges, ["u", "v"], "left_anti").isEmpty()  # both are distinct and of one size
        release(edges)
        edges, before = after, now
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _labelled(members: DataFrame, stars: DataFrame) -> DataFrame:
    """Bucket rows with their node's component and their leader's, main; written."""
    node = stars.select("node", "component")
    leader = stars.select(F.col("node").alias("leader"), F.col("component").alias("main"))
    found = members.join(node.hint("merge"), "node", "left").join(leader.hint("merge"), "leader", "left")
    return materialise(found.withColumn("component", F.coalesce("component", "node")).withColumn("main", F.coalesce("main", "leader")), "labelled")


def _joined(stars: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    if links.isEmpty():
        return stars
    return materialise(connected(links.union(stars.select(F.col("component").alias("a"), F.col("node").alias("b")))), "components")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: int = MIN_SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; sets that share ``min_share`` of a hundred are linked."""
    plan = Plan(min_share)
    rows = text_rows(docs, id_col, text_col)
    sketches = materialise(rows.mapInArrow(Tidy(_sketch(plan.registers)), "doc_id long, key binary, n_shingles long, bands array<long>, nibbles array<long>, parities array<long>"), "sketches")
    classes = materialise(sketches.groupBy("key").agg(F.min("doc_id").alias("node")), "classes")
    chosen = sketches.where("n_shingles > 0").join(classes.hint("merge"), (sketches["key"] == classes["key"]) & (sketches["doc_id"] == classes["node"]), "left_semi")
    buckets = materialise(chosen.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band")).distinct(), "buckets")
    leaders = materialise(buckets.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1"), "leaders")
    members = materialise(buckets.join(leaders.hint("merge"), "band"), "members")
    release(buckets)
    links = _verified(rows, members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), min_share)
    stars = materialise(connected(links), "components")

    seen = _labelled(members.where("members > 2"), stars)
    spots = [F.min(F.struct(F.xxhash64("node", F.lit(i)), F.col("node").alias("target"), F.col("component").alias("other"))).alias(f"t{i}") for i in range(TARGETS)]
    mixed = seen.where("component <> main").select("band").distinct()
    targets = materialise(seen.join(mixed, "band", "left_semi").groupBy("band").agg(*spots).select("band", F.explode(F.array(*[f"t{i}" for i in range(TARGETS)])).alias("t")).select("band", "t.target", "t.other").distinct(), "targets")
    tries = seen.where("component <> main").join(targets.hint("merge"), "band").where("component <> other")
    stars = _joined(stars, _verified(rows, tries.select(F.least("node", "target").alias("a"), F.greatest("node", "target").alias("b")).distinct(), min_share))

    # Pairs of one bucket that are in different components: at least one is outside the leader's.
    release(seen)
    seen = _labelled(members.where("members > 2"), stars)
    apart = seen.where("component <> main")
    signs = materialise(chosen.select(F.col("doc_id").alias("node"), "nibbles", "parities", "n_shingles").join(seen.join(apart.select("band").distinct(), "band", "left_semi").select("node").distinct().hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "signs")
    apart = apart.join(signs.hint("merge"), "node").select("band", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("nibbles").alias("sx"), F.col("parities").alias("px"), F.col("n_shingles").alias("nx"))
    others = seen.where("node <> leader").join(signs.hint("merge"), "node").select("band", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("nibbles").alias("sy"), F.col("parities").alias("py"), F.col("n_shingles").alias("ny"), (F.col("component") == F.col("main")).alias("in_main"))
    alike = F.expr("cx <> cy and (in_main or x < y)") & _may_link(min_share, "px", "py", "nx", "ny") & (_differing(plan.registers, "sx", "sy") <= plan.registers - plan.alike)
    rest = materialise(apart, "apart").join(materialise(others, "others").hint("merge"), "band").where(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    stars = _joined(stars, _verified(rows, rest, min_share))

    labels = stars.where("node <> component")
    by_class = materialise(classes.join(labels.hint("merge"), "node", "left").select("key", F.coalesce("component", "node").alias("component_id")), "class-components")
    for used in (members, links, seen, targets, signs, leaders):
        release(used)
    found = sketches.select("doc_id", "key", "n_shingles").join(by_class.hint("merge"), "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, min_share: int = MIN_SHARE) -> DataFrame:
    """The documents that ``components`` keeps, one row an id, with all their columns. Only rows of ids that occur twice are shuffled."""
    found = materialise(components(docs, min_share=min_share), "found")
    own = F.col("doc_id").cast("long")
    without = lambda df, ids: df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), own.eqNullSafe(F.col("_id")), "left_anti")
    dropped = materialise(found.where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    repeated = materialise(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"), "repeated")
    left = without(docs, dropped)
    if repeated.isEmpty():
        return left
    turn = F.row_number().over(Window.partitionBy(own).orderBy(F.length("text"), F.xxhash64("text")))
    again = left.join(repeated, own.eqNullSafe(F.col("_id")), "left_semi").withColumn("_turn", turn).where("_turn = 1").drop("_turn")
    return without(left, repeated).unionByName(again)
