"""Benchmark decontamination by templates: numbers, units and names become typed slots.

Both sides are read as tokens, the typed ones replaced by placeholders, and cut into windows of five
tokens. As a copy in other letter case hides its names, every text is also read without name slots, and
either reading may match. Windows meet in a hash join, so a benchmark of any size works; a bitmap of fixed size, made of
all benchmark windows, spares the shuffle the windows of documents that no item can have. A pair of a
document and an item counts when the document holds at least 0.8 of the item's windows in one alignment
and the slots agree: one value of the item stands for one value of the document throughout (a question
with other numbers or names), or for itself (a plain copy). An alignment is a place of the item in the
document; windows that an insertion moved away from it by the item's length at most count too. As slots
alone say little, what is not a plain copy must match three of the item's plain words, or all it has.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import ROW, columns, cut, keyed, slices

WINDOW, COVERED, LITERALS = 5, 0.8, 3
#: Bits of the bitmap as a power of two, tokens a task remembers, and characters read at once.
MAP_BITS, REMEMBERED, READ = 24, 400_000, 1 << 20
UNITS = frozenset("mm cm dm m km mg g kg t ml cl l s sec min h hr hour hours day days week weeks month months year years minute minutes second seconds meter meters metre "
                  "metres kilometer kilometers mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
                  "degree degrees percent dollar dollars euro euros cent cents usd eur gbp w kw kwh v a hz khz mhz ghz b kb mb gb tb kmh mph".split())
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(%|[a-zA-Z°]{1,4})?$")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%°]+$")
_WORD, _NUM, _UNIT, _KIND, _CAPITAL, _ENDS = 0, 1, 2, 3, 4, 8
_P = np.uint64(0x9E3779B97F4A7C15)
_HOLDERS = np.array([0, xxhash.xxh64_intdigest(b"<number>"), xxhash.xxh64_intdigest(b"<unit>"), xxhash.xxh64_intdigest(b"<name>")], np.uint64)


class _Places(dict):
    """Tokens to their places in two lists: hashes, and what is known of a token, as bits: its kind, _CAPITAL and
    _ENDS. A new token is worked out when it is asked for."""

    def __init__(self):
        super().__init__()
        self.hashes, self.known = [], []

    def __missing__(self, raw: str) -> int:
        self[raw] = n = len(self)
        flags, plain = 0, True
        if raw.isalpha():
            word = raw
        else:
            flags = _ENDS if raw[-1] in ".!?:" else 0
            if raw[-1] not in ",.;:!?" or not (word := raw[:-1]).isalpha():
                word, plain = _EDGE.sub("", raw), False
        low = word.lower()
        if low != word or not word.isascii():  # some capitals have no small letter
            flags |= _CAPITAL if word[:1].isupper() and not word.isupper() else 0
        self.hashes.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.known.append(flags | (_NUM if not plain and _NUMBER.match(word) else _UNIT if low in UNITS else _WORD))
        return n


class Templates:
    """Texts to window hashes. What a token is gets worked out once and remembered; the texts of a slice are
    read at once, with numpy."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.place, self.hashes, self.known = _Places(), np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def read(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """The tokens of each text, and of all in a row their hashes and each one's slot (0: none, else 1 number,
        2 unit, 3 name)."""
        words = [[] if t is None else t.split() for t in texts]
        if len(self.place) > REMEMBERED:
            self.forget()
        count = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))
        if self.place.hashes:
            self.hashes = np.concatenate([self.hashes, np.array(self.place.hashes, np.uint64)])
            self.known = np.concatenate([self.known, np.array(self.place.known, np.int8)])
            self.place.hashes, self.place.known = [], []
        known = self.known[at]
        kind, first, after_number = known & _KIND, np.zeros(len(at) + 1, bool), np.zeros(len(at) + 1, bool)
        first[1:], after_number[1:] = known & _ENDS > 0, kind == _NUM
        starts = np.cumsum(count) - count
        first[starts], after_number[starts] = True, False  # an empty text's start is the next one's
        slot = np.where(kind == _NUM, 1, np.where((kind == _UNIT) & after_number[:-1], 2, np.where((known & _CAPITAL > 0) & ~first[:-1], 3, 0))).astype(np.int8)
        return words, self.hashes[at], slot

    def windows(self, texts: list[str | None], size: int = WINDOW) -> Iterator[tuple[bool, list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For the readings with name slots and without: which, the tokens of each text, all slots in a row, and
        the windows' texts, their places in that row, their lengths and hashes. A text of fewer tokens is one window."""
        words, hashes, slot = self.read(texts)
        count = np.fromiter(map(len, words), np.int64, len(words))
        starts, own, total = np.cumsum(count) - count, np.minimum(size, count), np.where(count > 0, np.maximum(count - size, 0) + 1, 0)
        of = np.repeat(np.arange(len(words)), total)
        at = np.arange(len(of)) + (starts - (np.cumsum(total) - total))[of]
        whole, sizes = bool((own[of] == size).all()), own[of]
        for names in (True, False):
            if not names:
                slot = np.where(slot == 3, 0, slot).astype(np.int8)
            held = np.concatenate([np.where(slot > 0, _HOLDERS[slot], hashes), np.zeros(size, np.uint64)])
            h = (2 * sizes + names).astype(np.uint64)
            with np.errstate(over="ignore"):
                for i in range(size):
                    x = h ^ held[at + i]
                    x *= _P
                    x ^= x >> np.uint64(29)
                    h = x if whole else np.where(sizes > i, x, h)
            yield names, words, slot, of, at, sizes, h


def _clean(word: str) -> str:
    return _EDGE.sub("", word).lower()


_FIELDS = [("key", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string())), ("total", pa.int32()), ("tokens", pa.int32()), ("plain", pa.int32()), ("names", pa.bool_())]
_SCHEMA = "key long, at int, hash long, slots array<string>, total int, tokens int, plain int, names boolean"


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Keys and texts of a few rows; a text of over ``READ`` characters comes alone."""
    for b in slices(batches):
        keys, texts, weight = [], [], 0
        for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
            weight += len(text or "")
            if weight > READ and keys:
                yield keys, texts
                keys, texts, weight = [], [], len(text or "")
            keys.append(key), texts.append(text)
        yield keys, texts


def _window_rows(bitmap, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, bits = Templates(), None if bitmap is None else bitmap.value
    for keys, texts in _together(batches):
        rows = []
        for names, words, slot, of, at, sizes, h in reader.windows(texts):
            if bits is not None:
                top = h >> np.uint64(64 - MAP_BITS)
                hit = (bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8)) & 1
                chosen = np.flatnonzero(hit)
            else:
                chosen = np.arange(len(h))
            count = list(map(len, words))
            start = np.cumsum(count) - count
            total, until = np.bincount(of, minlength=len(words)).tolist(), np.concatenate([[0], np.cumsum(slot == 0)])
            plain = (until[start + count] - until[start]).tolist()
            start = start.tolist()
            for r, g, s, value in zip(of[chosen].tolist(), at[chosen].tolist(), sizes[chosen].tolist(), h[chosen].view(np.int64).tolist()):
                p, kinds = g - start[r], slot[g:g + s].tolist()
                slots = [f"{i}:{k}:{_clean(words[r][p + i])}" for i, k in enumerate(kinds) if k]
                rows.append((keys[r], p, value, slots, total[r], count[r], plain[r], names))
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip([c for c, _ in _FIELDS], map(list, zip(*rows)))), pa.schema(_FIELDS))


def windows(df: DataFrame, key: str, text: str, bitmap=None) -> DataFrame:
    return columns(df, key=key, text=text).mapInArrow(partial(_window_rows, bitmap), _SCHEMA)


def window_bitmap(items: DataFrame):
    """A broadcast bitmap of the top ``MAP_BITS`` bits of all hashes: two megabytes for any benchmark."""
    top = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    words = items.select(F.shiftright(top, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), top.bitwiseAND(31).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toPandas()  # 2^(MAP_BITS - 5) rows at most
    out = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return items.sparkSession.sparkContext.broadcast(out.astype("<u4").view(np.uint8))


def _agree(hits: list[tuple[int, int, list[str], list[str]]], total: int, tokens: int, plain: int) -> tuple[float, bool, int]:
    """Of hits with one for each place in the item: the share of its windows whose slots agree, whether
    all of these are equal, and where they start. No share where too few plain words agree."""
    votes: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for _, _, theirs, ours in hits:
        for x, y in zip(theirs, ours):
            votes[y.partition(":")[2]][x.partition(":")[2]] += 1
    means = {y: max(sorted(xs), key=xs.get) for y, xs in votes.items()}
    taken: dict[str, str] = {}
    for y in sorted(means):  # two values of the item cannot stand for one of the document
        taken.setdefault(means[y], y)
    good = [h for h in hits if all(means[y.partition(":")[2]] == x.partition(":")[2] and taken[x.partition(":")[2]] == y.partition(":")[2] for x, y in zip(h[2], h[3]))]
    if not good:
        return 0.0, False, 0
    same, size = all(h[2] == h[3] for h in good), min(WINDOW, tokens)
    matched = {h[1] + i for h in good for i in range(size)} - {h[1] + int(y.partition(":")[0]) for h in good for y in h[3]}
    enough = same or len(matched) >= max(1, min(LITERALS, plain))
    return len(good) / total if enough else 0.0, same, min(h[0] for h in good)


def _judge(hits: list[tuple[int, int, list[str], list[str]]], total: int, tokens: int, covered: float, plain: int = LITERALS) -> tuple[float, bool, int] | None:
    """The best alignment of a document with one item: share of its windows, whether every slot is equal,
    and where. A hit is (place in the document, place in the item, the document's slots, the item's).

    Every alignment that a hit names is judged by its own hits, and again with those that lie up to half
    the item's length and its whole length beside it, of which each place in the item takes the nearest."""
    best = None
    hits = sorted(hits, key=lambda x: (x[0] - x[1], x[1]))
    beside = np.array([h[0] - h[1] for h in hits])
    for d in np.unique(beside).tolist():
        seen = None
        for slack in (0, tokens // 2, tokens):
            a, b = np.searchsorted(beside, [d - slack, d + slack + 1]).tolist()
            if b - a < covered * total or (a, b) == seen:
                continue
            seen, near = (a, b), {}
            for h in sorted(hits[a:b], key=lambda h: abs(h[0] - h[1] - d)):
                near.setdefault(h[1], h)
            if len(near) < covered * total:
                continue
            share, same, at = _agree(list(near.values()), total, tokens, plain)
            if share >= covered and (best is None or (share, same) > best[:2]):
                best = (share, same, at)
        if best is not None and best[:2] == (1.0, True):
            break
    return best


def _pairs(covered: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        rows = []
        for r in b.to_pylist():
            if found := _judge([(h["at"], h["item_at"], h["slots"], h["item_slots"]) for h in r["hits"]], r["total"], r["tokens"], covered, r["plain"]):
                rows.append((r["key"], r["item"], found[0], "copy" if found[1] else "reparameterised", found[2]))
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(["doc_id", "item_id", "covered", "kind", "at"], map(list, zip(*rows)))),
                                             pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.float64()), ("kind", pa.string()), ("at", pa.int32())]))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", covered: float = COVERED) -> DataFrame:
    """doc_id, item_id, covered (share of the item's windows), kind (copy or reparameterised) and at (the
    token where it starts), a row for each document and item that meet the rule.

    Null and empty texts hold no window and give no row. Items that repeat an item_id are read as one
    item each by their own text's hash and reported by their least id's row; a null item_id or doc_id is reported as null.
    Rows that repeat a doc_id are read as parts of one document. Empty tables give no rows."""
    one = columns(benchmark, item=item_id, text=item_text).groupBy("text").agg(F.min("item").alias("item"))
    items = one.withColumn("n", F.xxhash64("text"))
    grams = cut(windows(items, "n", "text").select(F.col("key").alias("n"), F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"), "total", "tokens", "plain", "names"), "decontam-items")
    found = cut(windows(docs, doc_id, text, window_bitmap(grams)).select("key", "at", "hash", "slots"), "decontam-found")
    # a pair with too few of an item's windows is settled by distinct hashes, before its hits are gathered
    of = grams.groupBy("hash", "n", "names").agg(F.count("*").alias("times"), F.first("total").alias("total"), F.first("tokens").alias("tokens"), F.first("plain").alias("plain"))
    need = (found.select("key", "hash").distinct().join(of, "hash").groupBy("key", "n", "names")
            .agg(F.sum("times").alias("seen"), F.first("total").alias("total"), F.first("tokens").alias("tokens"), F.first("plain").alias("plain")).filter(F.col("seen") >= covered * F.col("total")))
    need = cut(need.join(items.select("n", "item"), "n"), "decontam-pairs")
    want = need.select(F.col("key").alias("of_key"), "n", "names", "item", "total", "tokens", "plain").join(grams.select("n", "names", "hash", "item_at", "item_slots"), ["n", "names"])
    met = found.join(want, (found["hash"] == want["hash"]) & found["key"].eqNullSafe(want["of_key"])).filter(F.size("slots") == F.size("item_slots"))
    hits = met.groupBy("key", "item", "n", "names", "total", "tokens", "plain").agg(F.collect_list(F.struct("at", "item_at", "slots", "item_slots")).alias("hits"))
    judged = hits.select("key", "item", "total", "tokens", "plain", "hits").mapInArrow(partial(_pairs, covered), "doc_id long, item_id long, covered double, kind string, at int")
    best = F.max_by(F.struct("kind", "at"), F.struct("covered", F.col("kind") == "copy", "at"))
    return judged.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), best.alias("best")).select("doc_id", "item_id", "covered", "best.kind", "best.at")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """The rows, all columns, that hold no item of the benchmark; each row is judged by its own text."""
    rows = keyed(docs)
    bad = contaminated(rows, benchmark, doc_id=ROW, covered=covered).select(F.col("doc_id").alias(ROW)).distinct()
    return rows.join(bad, ROW, "left_anti").drop(ROW)
