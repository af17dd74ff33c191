"""Word bigram language model with interpolated modified Kneser-Ney smoothing.

Texts are read once into batches: a sorted array of the hashes of a batch's words, and its tokens as
places in it. Counting and scoring share their exchanges. A batch sends the owner of each hash range its
sorted words and pairs with their training counts; the owner adds up what all batches sent, keeps its
range of the model as sorted hash arrays in a file that it maps into memory, looks every list up in it
and answers with counts in the list's own order. Scores come from a batch and its answers.

Three exchanges: words (counts, for the base score), pairs (counts; from them what each word is as a
context and in how many contexts it was seen), and words once more (those sums). All lists are sorted
hashes coded by their differences. An owner's range holds about ``PAIRS`` or ``WORDS`` entries whatever
the corpus's size. A context's pairs lie with one owner, except for the at most ``HOT`` words that are
more than 1/HOT of all training tokens, whose pairs are dealt out by the second word.

Hashes: words 64 bits; contexts and second words inside a list 48 and 40 bits, where one in a trillion
lookups may meet another word's entry. The base score does not depend on these.
"""

from __future__ import annotations

import struct
import tempfile
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import as_bytes, bits_for, columns, crc_mod, cut, slices
from tracehold.llm.golomb_dedup import decode, encode

HELD_OUT, HELD_AT = 5, 1
BATCH_TOKENS, WORDS, PAIRS, HOT = 2_000_000, 1 << 20, 1 << 21, 1 << 16
_hash = xxhash.xxh64_intdigest
#: A word has no white space, so these are no word's.
END, BEGIN = _hash(b" end"), _hash(b" begin")


# ---- lists as bytes

def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers, coded by their differences."""
    if not len(values):
        return b""
    k, first, unary, low = encode(values)
    return struct.pack("<QIQI", first, k, len(values), len(unary)) + unary + low


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    first, k, n, size = struct.unpack_from("<QIQI", data)
    return decode(n, k, first, data[24:24 + size], data[24 + size:])


def pack_ints(*columns_: np.ndarray) -> bytes:
    """Columns of equal length of small integers, by byte planes."""
    x = np.ascontiguousarray(np.concatenate([np.asarray(c, np.uint64) for c in columns_]))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_ints(data: bytes, columns_: int = 1) -> np.ndarray:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(x).view(np.uint64).reshape(columns_, -1).astype(np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """40-bit integers in five bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(data: bytes) -> np.ndarray:
    x = np.zeros((len(data) // 5, 8), np.uint8)
    x[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return x.view("<u8").ravel()


def _ranges(owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """owner, from, to of the runs of a sorted array."""
    if len(owner):
        at = np.flatnonzero(np.diff(owner)) + 1
        for a, b in zip([0, *at.tolist()], [*at.tolist(), len(owner)]):
            yield int(owner[a]), a, b


class _Mapped:
    """Arrays in a file of the task's own, mapped while the task looks them up."""

    def __init__(self, **arrays: np.ndarray):
        self.file, self.at = tempfile.TemporaryFile(), {}
        for name, x in arrays.items():
            self.at[name] = (self.file.tell(), x.dtype, len(x))
            x.tofile(self.file)
        self.file.flush()

    def __getitem__(self, name: str) -> np.ndarray:
        offset, dtype, n = self.at[name]
        return np.memmap(self.file, dtype, "r", offset, (n,)) if n else np.zeros(0, dtype)


# ---- batches

_BATCH = "batch string, docs array<long>, held array<boolean>, sizes array<int>, vocab binary, tokens binary, n_words long, n_tokens long, n_train long"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, serial = TaskContext.get().partitionId(), 0
    place, hashes, tokens, docs, held, sizes = {}, [END, BEGIN], array("i"), [], [], []

    def row() -> pa.RecordBatch:
        h = np.array(hashes, np.uint64)
        order = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        t = rank[np.frombuffer(tokens, np.int32)]
        train = np.repeat(~np.array(held, bool), sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{task}-{serial}"]), pa.array([docs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack(h[order])], pa.binary()),
             pa.array([pack_ints(t)], pa.binary()), pa.array([len(h)]), pa.array([len(t)]), pa.array([int(train.sum())])], [c.split()[0] for c in _BATCH.split(", ")])

    for b in slices(batches):
        for doc, out, text in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), b.column("text").to_pylist()):
            words = as_bytes(text).lower().split()
            for w in words:
                if w not in place:
                    place[w] = len(hashes)
                    hashes.append(_hash(w))
            tokens.extend([place[w] for w in words])
            tokens.append(0)
            docs.append(doc), held.append(out), sizes.append(len(words) + 1)
            if len(tokens) >= BATCH_TOKENS:
                yield row()
                place, hashes, tokens, docs, held, sizes, serial = {}, [END, BEGIN], array("i"), [], [], [], serial + 1
    if docs:
        yield row()


class Batch:
    """A batch of texts as arrays."""

    def __init__(self, r):
        self.vocab, self.tokens = unpack(r["vocab"]), unpack_ints(r["tokens"])[0]
        self.sizes, self.held = np.array(r["sizes"], np.int64), np.array(r["held"], bool)
        self.train = np.repeat(~self.held, self.sizes)

    def counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.vocab))

    def pairs(self, bits: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs by owner, context and word: owners, contexts, words (places in the vocabulary),
        training counts, and each token's pair."""
        starts = np.cumsum(self.sizes) - self.sizes
        context = np.roll(self.tokens, 1)
        context[starts] = int(np.searchsorted(self.vocab, np.uint64(BEGIN)))
        v = len(self.vocab)
        keys, inverse = np.unique(context * v + self.tokens, return_inverse=True)
        c, w = keys // v, keys % v
        counts = np.bincount(inverse[self.train], minlength=len(keys))
        h = _mixed(self.vocab[c])
        many = np.isin(self.vocab, hot)[c]
        h[many] = _mixed(h[many] ^ self.vocab[w[many]])
        owner = (h >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return owner[order], c[order], w[order], counts[order], back[inverse]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


# ---- exchanges: lists out, answers back

_LIST = "owner int, kind string, batch string, keys binary, sizes binary, words binary, counts binary"
_ANSWER = "batch string, kind string, owner int, counts binary"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in slices(batches, 1):
        yield from b.to_pylist()


def _send_words(bits: int, counted: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _each(batches):
        b = Batch(r)
        counts = b.counts() if counted else None
        yield _table([(o, "query", r["batch"], pack(b.vocab[x:y]), None, None, pack_ints(counts[x:y]) if counted else None)
                      for o, x, y in _ranges((b.vocab >> np.uint64(64 - bits)).astype(np.int64))], _LIST)


def _own_words(hot_from: int, lists: pd.DataFrame) -> pd.DataFrame:
    """Training counts of one owner's words; the words over ``hot_from``, and how many words were trained on."""
    keys = [unpack(k) for k in lists["keys"]]
    words, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([unpack_ints(c)[0] for c in lists["counts"]]), len(words)).astype(np.int64)
    model = _Mapped(words=words, counts=counts)
    owner = int(lists["owner"].iloc[0])
    rows = [(b, "word", owner, pack_ints(model["counts"][np.searchsorted(model["words"], k)])) for b, k in zip(lists["batch"], keys)]
    rows.append(("", "hot", owner, pack(words[counts > hot_from])))
    rows.append(("", "types", owner, pack_ints(np.array([(counts > 0).sum()]))))
    return pd.DataFrame(rows, columns=["batch", "kind", "owner", "counts"])


def _send_pairs(bits: int, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _each(batches):
        b = Batch(r)
        owner, c, w, n, _ = b.pairs(bits, hot)
        for o, x, y in _ranges(owner):
            head = np.flatnonzero(np.diff(c[x:y], prepend=-1))
            yield _table([(o, "pairs", r["batch"], pack(b.vocab[c[x:y][head]] >> np.uint64(16)), pack_ints(np.diff(head, append=y - x)), _narrow(b.vocab[w[x:y]] >> np.uint64(24)), pack_ints(n[x:y]))], _LIST)


def _own_pairs(word_bits: int, lists: pd.DataFrame) -> pd.DataFrame:
    """Counts of one owner's pairs for every list, and what they say of words, for the words' owners:
    of contexts the tokens after them and how many pairs have one, two and more; of second words the
    number of contexts."""
    decoded = []
    for r in lists.itertuples():
        decoded.append((np.repeat(unpack(r.keys), unpack_ints(r.sizes)[0]), _wide(r.words), unpack_ints(r.counts)[0]))
    contexts, at = np.unique(np.concatenate([c for c, _, _ in decoded]), return_inverse=True)
    keys = (at.astype(np.uint64) << np.uint64(40)) | np.concatenate([w for _, w, _ in decoded])
    pairs, inverse = np.unique(keys, return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([n for _, _, n in decoded]), len(pairs)).astype(np.int64)
    model, owner = _Mapped(pairs=pairs, counts=counts), int(lists["owner"].iloc[0])
    rows, a = [], 0
    for b, (c, _, _) in zip(lists["batch"], decoded):
        rows.append((owner, "pair", b, None, None, None, pack_ints(model["counts"][np.searchsorted(model["pairs"], keys[a:a + len(c)])])))
        a += len(c)
    seen = counts > 0
    n, c, w = counts[seen], (pairs[seen] >> np.uint64(40)).astype(np.int64), pairs[seen] & np.uint64((1 << 40) - 1)
    sums = [np.bincount(c, x, len(contexts)).astype(np.int64) for x in (n, n == 1, n == 2, n > 2)]
    for o, x, y in _ranges((contexts >> np.uint64(48 - word_bits)).astype(np.int64)):
        rows.append((o, "context", "", pack(contexts[x:y]), None, None, pack_ints(*[s[x:y] for s in sums])))
    words, times = np.unique(w, return_counts=True)
    for o, x, y in _ranges((words >> np.uint64(40 - word_bits)).astype(np.int64)):
        rows.append((o, "second", "", pack(words[x:y]), None, None, pack_ints(times[x:y])))
    rows.append((owner, "of", "", None, None, None, pack_ints(np.array([(n == i).sum() for i in (1, 2, 3, 4)]))))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _LIST.split(", ")])


def _summed(lists: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(lists):
        return np.zeros(0, np.uint64), np.zeros((width, 0), np.int64)
    keys, inverse = np.unique(np.concatenate([unpack(k) for k in lists["keys"]]), return_inverse=True)
    values = np.concatenate([unpack_ints(c, width) for c in lists["counts"]], axis=1)
    return keys, np.stack([np.bincount(inverse, v, len(keys)).astype(np.int64) for v in values])


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _own_sums(lists: pd.DataFrame) -> pd.DataFrame:
    """For every list of words: contexts seen before each, and what each is as a context."""
    contexts, sums = _summed(lists[lists["kind"] == "context"], 4)
    words, times = _summed(lists[lists["kind"] == "second"], 1)
    model, owner = _Mapped(contexts=contexts, words=words, times=times[0], **{f"s{i}": s for i, s in enumerate(sums)}), int(lists["owner"].iloc[0])
    rows = []
    for r in lists[lists["kind"] == "query"].itertuples():
        k = unpack(r.keys)
        rows.append((r.batch, "sums", owner, pack_ints(_found(model["words"], model["times"], k >> np.uint64(24)), *[_found(model["contexts"], model[f"s{i}"], k >> np.uint64(16)) for i in range(4)])))
    t = times[0]
    rows.append(("", "seconds", owner, pack_ints(np.array([(t == i).sum() for i in (1, 2, 3, 4)] + [(t > 2).sum(), t.sum()]))))
    return pd.DataFrame(rows, columns=["batch", "kind", "owner", "counts"])


# ---- scores

def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of one, two and more, from how many counts are one to four."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(np.clip(x, 0.05 * i, i)) for i, x in enumerate(d, 1))


def _taken(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)


def smoothed(n: np.ndarray, c: np.ndarray, one: np.ndarray, two: np.ndarray, more: np.ndarray, lower: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """P(word | context): n of the pair; c, one, two, more of the context; lower is the word's own."""
    return np.where(c > 0, (_taken(n, d) + (d[0] * one + d[1] * two + d[2] * more) * lower) / np.maximum(c, 1), lower)


def lowest(times: np.ndarray, seconds: np.ndarray, types: int) -> np.ndarray:
    """P(word) by the number of contexts before it, mixed with an even share for each known word and one unknown."""
    m1, m2, _, _, m3, total = seconds.tolist()
    if not total:
        return np.full(len(times), 1 / (types + 1))
    d = discounts(*seconds[:4].tolist())
    return _taken(times, d) / total + (d[0] * m1 + d[1] * m2 + d[2] * m3) / total / (types + 1)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(bits: int, hot: np.ndarray, tokens: int, types: int, of: np.ndarray, seconds: np.ndarray, batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    r = batch.iloc[0]
    b = Batch(r)
    get = lambda kind, width: np.concatenate([unpack_ints(c, width) for c in answers[answers["kind"] == kind].sort_values("owner")["counts"]], axis=1)
    count, (times, c, one, two, more), (n,) = get("word", 1)[0], get("sums", 5), get("pair", 1)
    _, ctx, word, _, of_token = b.pairs(bits, hot)
    p = smoothed(n, c[ctx], one[ctx], two[ctx], more[ctx], lowest(times, seconds, types)[word], discounts(*of.tolist()))
    base = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))
    starts = np.cumsum(b.sizes) - b.sizes
    by_doc = lambda x: np.add.reduceat(x, starts)
    return pd.DataFrame({"doc_id": pd.array(list(r["docs"]), dtype="Int64"), "held_out": b.held, "n_tokens": b.sizes, "n_known": by_doc((count > 0)[b.tokens].astype(np.int64)),
                         "train_tokens": tokens, "base_score": by_doc(base[b.tokens]), "score": by_doc(np.log10(p)[of_token])})


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every whole text.

    The model is counted from the rows whose crc32(doc_id) modulo 5 is not 1. base_score is the smoothed
    unigram score, score the model's log10 probability; the end counts as a token, so null and empty
    texts have one. A null id is the empty text to the checksum. Repeated rows count and are scored
    each. An empty table gives no rows; without training rows every probability is one."""
    base = columns(docs, doc_id=doc_id, text=text).select("doc_id", "text", (crc_mod(F.col("doc_id"), HELD_OUT) == HELD_AT).alias("held"))
    batches = cut(base.mapInArrow(_batches, _BATCH), "ngram-batches")
    total = batches.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("train")).first()
    word_bits, pair_bits = bits_for(total["words"], WORDS, 3), bits_for(total["all"], PAIRS, 4)
    words = cut(batches.mapInArrow(partial(_send_words, word_bits, True), _LIST).groupBy("owner").applyInPandas(partial(_own_words, total["train"] // HOT), _ANSWER), "ngram-words")
    few = {kind: [r["counts"] for r in words.filter(F.col("kind") == kind).collect()] for kind in ("hot", "types")}  # HOT words at most, a number for each owner
    hot = np.concatenate([np.zeros(0, np.uint64), *map(unpack, few["hot"])])
    types = sum(int(unpack_ints(x)[0, 0]) for x in few["types"])
    pairs = cut(batches.mapInArrow(partial(_send_pairs, pair_bits, hot), _LIST).groupBy("owner").applyInPandas(partial(_own_pairs, word_bits), _LIST), "ngram-pairs")
    lists = batches.mapInArrow(partial(_send_words, word_bits, False), _LIST).unionByName(pairs.filter("kind IN ('context', 'second')"))
    sums = cut(lists.groupBy("owner").applyInPandas(_own_sums, _ANSWER), "ngram-sums")
    add = lambda df, kind, width: sum((unpack_ints(r["counts"])[0] for r in df.filter(F.col("kind") == kind).select("counts").collect()), np.zeros(width, np.int64))
    of, seconds = add(pairs, "of", 4), add(sums, "seconds", 6)  # a few numbers for each owner
    answers = words.filter("kind = 'word'").unionByName(sums.filter("kind = 'sums'")).unionByName(pairs.filter("kind = 'pair'").select("batch", "kind", "owner", "counts"))
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(partial(_score, pair_bits, hot, total["train"], types, of, seconds), _SCORES)
