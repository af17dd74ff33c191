"""SimHash near-duplicates: fingerprints linked by BK-trees, classes as connected components.

A fingerprint has 64 bits. Two that differ in at most two bits agree in at least two of their four
16-bit blocks, so every link lies in one of six buckets keyed by two blocks. Each bucket is a shard
with a BK-tree of its own: children are keyed by their Hamming distance to the parent, and a search
follows only the edges within the radius of the distance found. A bucket over ``SHARD`` fingerprints
is dealt out once more by two of the four bytes of its other half, so a shard holds 65,536 distinct
fingerprints at most whatever the input. Shards go to tasks by a shuffle: a broadcast of all trees
would grow with the corpus.

A shard emits a spanning forest of its links, never all pairs of a group. Copies share a fingerprint
and take part once.

For a radius over two, fingerprints are wider and buckets are drawn bits instead of blocks of four
(``wide``, ``bucket_links``): each bucket has a BK-tree for each class of values found so far, and a value
looks for one link to each class, the middle of the bucket first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import as_bytes, columns, cut, partitions, slices

WORDS, RADIUS, SHARD = 3, 2, 1024
_PIECE = 1 << 16
#: Bits of the wide fingerprint that BK-trees compare; rows that share a bucket's key by chance, at most, on average.
COMPARED, CHANCE = 128, 256
#: Of pairs at a similarity, the share that meet in no bucket or are outside the radius, each at most.
MISSED, SPREAD = 0.002, 3.1
_LANES = np.uint64(0x0101010101010101)
_EACH = np.random.default_rng(9).integers(0, 1 << 63, 1 << 10, dtype=np.uint64)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def simhash(text: str | None, words: int = WORDS) -> int:
    """Unsigned fingerprint; zero for a text without words (null and empty texts too)."""
    w = as_bytes(text).lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else iter([b" ".join(w)])
    n = max(1, len(w) - words + 1)
    hashes = np.fromiter(map(_hash, shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        ones += np.unpackbits(hashes[at:at + _PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def differing(similar: float) -> float:
    """The share of fingerprint bits that differ between sets of that Jaccard similarity."""
    return math.acos(min(1.0, 2 * similar / (1 + similar))) / math.pi


def layout(similar: float, rows: int) -> tuple[int, int, int]:
    """Bits of a bucket's key, how many keys a text has, and the radius within ``COMPARED`` bits."""
    bits, off = max(16, math.ceil(math.log2(max(1, rows) / CHANCE))), differing(similar)
    meet = min((1 - off) ** bits, 1 - 1e-9)
    return bits, math.ceil(math.log(MISSED) / math.log(1 - meet)), math.ceil(COMPARED * off + SPREAD * math.sqrt(COMPARED * off * (1 - off)))


def wide(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprint bits of a set of hashes, at least as many as asked: a bit is set where more than half of
    the hashes have it. Every 64 bits come from the hashes mixed anew, so no two share their errors."""
    turns = _EACH[:-(-bits // 64)]
    ones = np.zeros((8, len(turns), 8), np.int64)
    for at in range(0, len(hashes), 255):  # a byte counts up to 255
        x = turns[:, None] ^ hashes[at:at + 255]
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        for k in range(8):
            lanes = x >> np.uint64(k)
            lanes &= _LANES
            ones[k] += lanes.sum(axis=1).view(np.uint8).reshape(-1, 8)
    return (2 * ones > len(hashes)).transpose(1, 0, 2).ravel()


def _fingerprints(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fps = np.array([simhash(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.record_batch([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long), a row for each row."""
    return columns(docs, doc_id=doc_id, text=text).mapInArrow(partial(_fingerprints, words), "doc_id long, fp long")


def _part(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)


def _pair_keys(fp: Column, at: int, width: int) -> Column:
    """For each two of the four parts of ``width`` bits from bit ``at``: which two, and their values."""
    return F.array(*[F.shiftleft(F.lit(i).cast("long"), 2 * width).bitwiseOR(F.shiftleft(_part(fp, at + a * width, width), width)).bitwiseOR(_part(fp, at + b * width, width))
                     for i, (a, b) in enumerate(combinations(range(4), 2))])


def _rest(fp: Column, key: Column) -> Column:
    """The 32 bits of a fingerprint that its bucket's key does not hold, as a long."""
    which, out = F.shiftright(key, 32), None
    for i, (a, b) in enumerate(combinations(range(4), 2)):
        c, d = sorted({0, 1, 2, 3} - {a, b})
        v = F.shiftleft(_part(fp, 16 * c, 16), 16).bitwiseOR(_part(fp, 16 * d, 16))
        out = F.when(which == i, v) if out is None else out.when(which == i, v)
    return out


class BKTree:
    """Distinct integers under Hamming distance."""

    def __init__(self, root: int):
        self.values, self.children = [root], [{}]

    def add(self, value: int) -> None:
        at = 0
        while True:
            d = (value ^ self.values[at]).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = self.children[at][d]

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of the values within the radius."""
        stack = [0]
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            stack += [kids[e] for e in range(max(1, d - radius), d + radius + 1) if e in kids]


def _forest(fps: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what the radius connects, without any that closes a ring."""
    fps = sorted(set(fps))
    tree, up = BKTree(fps[0]), [0]

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, v in enumerate(fps[1:], 1):  # values enter in order, so a value's place in the tree is its place here
        up.append(i)
        for j in tree.within(v, radius):
            a, b = top(i), top(j)
            if a != b:
                up[a] = b
                yield v, fps[j]
        tree.add(v)


def _links(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 4096):
        found = [(x, y) for fps in b.column("fps").to_pylist() for x, y in _forest([v & (1 << 64) - 1 for v in fps], radius)]
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.record_batch([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Distinct links a, b between the fingerprints of ``nodes`` (column fp, distinct) that span all
    pairs within the radius, which is two at most."""
    if not 0 <= radius <= 2:
        raise ValueError("four blocks find links of two bits at most")
    keyed = cut(nodes.select("fp", F.explode(_pair_keys(F.col("fp"), 0, 16)).alias("key")), "simhash-keys")
    sized = keyed.groupBy("key").count().filter("count > 1")
    small, large = sized.filter(F.col("count") <= shard), sized.filter(F.col("count") > shard)
    of = keyed.join(small, "key", "left_semi").groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    finer = (keyed.join(large, "key", "left_semi").select("fp", "key", F.explode(_pair_keys(_rest(F.col("fp"), F.col("key")), 0, 8)).alias("sub"))
             .groupBy("key", "sub").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps"))
    return of.unionByName(finer).mapInArrow(partial(_links, radius), "a long, b long").distinct()


def class_links(values: list[int], radius: int, labels: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Places of distinct values, as links that connect what the radius connects. A value looks for one link
    to each class of those before it, so a crowd costs each member a look, not one for each other member.
    Values of one label are connected already and need no link."""
    classes: list[tuple[set[int], list[tuple[BKTree, list[int]]]]] = []
    for i, v in enumerate(values):
        own, met, apart = {i if labels is None else labels[i]}, [], []
        for c in classes:
            held, trees = c
            hit = None
            if own.isdisjoint(held) and (hit := next((of[j] for tree, of in trees for j in tree.within(v, radius)), None)) is None:
                apart.append(c)
                continue
            met.append(c)
            if hit is not None:
                yield i, hit
        trees = [t for _, ts in met for t in ts]
        if trees:
            tree, of = trees[0]
            tree.add(v)
            of.append(i)
        else:
            trees = [(BKTree(v), [i])]
        classes = [(own.union(*[held for held, _ in met]), trees), *apart]


def middle_first(values: list[int]) -> list[int]:
    """Places of the values, those first that are nearest to the bits most of them have."""
    raw = np.frombuffer(b"".join(v.to_bytes(COMPARED // 8, "big") for v in values), np.uint8).reshape(len(values), -1)
    most = np.packbits(2 * sum(np.unpackbits(raw[at:at + _PIECE], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(raw), _PIECE)) > len(values))
    return np.argsort(np.bitwise_count(raw ^ most).sum(axis=1, dtype=np.int64), kind="stable").tolist()


def _bucket_links(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, so a bucket's rows follow each other."""
    def linked(node: list[int], value: list[int], label: list[int], found: list[tuple[int, int]]) -> None:
        up = {x: x for x in label}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        first: dict[int, tuple[int, int]] = {}
        for n, v, x in zip(node, value, label):
            m, y = first.setdefault(v, (n, x))
            if (x := top(x)) != (y := top(y)):
                found.append((n, m))
                up[x] = y
        values, nodes, labels = list(first), [n for n, _ in first.values()], [top(x) for _, x in first.values()]
        if len(set(labels)) < 2:
            return
        order = middle_first(values) if len(values) > 16 else range(len(values))
        values, nodes, labels = ([of[i] for i in order] for of in (values, nodes, labels))
        found += [(nodes[i], nodes[j]) for i, j in class_links(values, radius, labels)]

    last, node, value, label = None, [], [], []
    for b in batches:
        key, high, low = (b.column(c).to_numpy() for c in ("key", "high", "low"))
        nodes, labels = b.column("node").to_pylist(), b.column("label").to_pylist()
        values = [x << 64 | y for x, y in zip(high.view(np.uint64).tolist(), low.view(np.uint64).tolist())]
        starts, found = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)], []
        for lo, hi in zip(starts[:-1], starts[1:]):
            if lo == hi:
                continue
            if key[lo] != last:
                if len(node) > 1:
                    linked(node, value, label, found)
                last, node, value, label = key[lo], [], [], []
            node += nodes[lo:hi]
            value += values[lo:hi]
            label += labels[lo:hi]
        yield _ends(found)
    found = []
    if len(node) > 1:
        linked(node, value, label, found)
    yield _ends(found)


def _ends(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array([(min(x), max(x)) for x in set(found)], np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])


def bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Distinct links a, b between the nodes of each bucket of ``keyed`` (node, key, and high and low, the
    halves of the fingerprint), which connect what the radius connects within the bucket. Nodes of one ``label``,
    if there is such a column, count as connected."""
    label = F.col("label" if "label" in keyed.columns else "node").alias("label")
    laid = keyed.select("key", "node", "high", "low", label).repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key")
    return laid.mapInArrow(partial(_bucket_links, radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label for every end of an edge; nodes have one label exactly when edges connect them.
    Each round hooks every node to its least neighbour and contracts, so the edges left fall quickly. An edge
    is held once, not once for each direction."""
    def once(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    e = cut(edges.filter("a <> b").select(*once("a", "b")).distinct(), "simhash-edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")), "simhash-hooks")
        jump = hook.select(F.col("a").alias("root"), F.col("root").alias("next"))
        hook = cut(hook.join(jump, "root", "left").select("a", F.coalesce("next", "root").alias("root")), "simhash-hooks")
        to = hook.select(F.col("a").alias("label"), "root")
        labels = (hook.select(F.col("a").alias("node"), F.col("root").alias("label")) if labels is None
                  else labels.join(to, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        labels = cut(labels, "simhash-labels")
        moved = e.join(hook, "a").select(F.col("root").alias("a"), "b").join(hook.select(F.col("a").alias("b"), F.col("root").alias("to")), "b")
        e = cut(moved.filter("a <> to").select(*once("a", "to")).distinct(), "simhash-edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id (the least doc_id that links reach) for
    every row. Null and empty texts have fingerprint zero and link like any other; a null doc_id keeps
    its row and never names a component that has another id; a repeated row gives its row again; an
    empty table gives none."""
    fps = cut(fingerprints(docs, doc_id, text, words), "simhash")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = components(cut(links(nodes.select("fp"), radius), "simhash-links"))
    linked = labels.join(nodes, labels["node"] == nodes["fp"]).select("fp", "label", "least")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    # written, so that the join below deals out both sides itself and can split a frequent fingerprint
    of = cut(nodes.join(linked.join(least, "label").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-components")
    return fps.join(of, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
