"""Token ids in flat binary files: unsigned ids, 64-bit document offsets, memory-mapped reading.

Documents are dealt to shards by ranges of their id and sorted there, so the shards, in the order of
their numbers, hold all documents in ascending order. A task tokenises its shard and writes one file
(little-endian throughout):

    ids      n_ids x u16      the ids of all documents, each document's end id included; u32 where the
                              vocabulary has more than 65,536 ids
    padding  zero bytes       up to a multiple of eight
    table    n_docs x 2 x 64  doc_id (signed) and the place of its first id in this file; bit 55 of the
                              place is set where the row has no doc_id
    footer   2 x u64          n_docs, n_ids times 8 plus the bytes of an id

A shard's base is the sum of n_ids of all shards before it; bases are prefix sums over the footers and lie
in the table ``manifest`` beside the files, so no shard waits for another one. Every run of a file ends
with a zero byte (the end id is under 256, places and counts under 2^55), so Spark's text writer, with a
zero byte as its line separator, writes the bytes as they are on any store Spark can reach, and its commit
keeps the files of lost or repeated tasks out. Readers map a task's own copy of one file into memory.

The parts a text is split into are looked up in a table of parts met before, kept by a worker from task
to task; a part that is not in it goes to the tokenizers library, straight to its model where all its
characters are known ones, else whole. That is exact for ``word_bpe_49k.json``, which normalises and splits
inside what white space parts; texts that hold a special token's string are encoded whole.
"""

from __future__ import annotations

import mmap
import os
import re
import tempfile
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.llm.common import columns, cut, slices
from tracehold.operators.prefix import running_total
from tracehold.session import scratch

MODEL = "word_bpe_49k.json"
END = 1
#: Bytes of text of a shard, on average, and words that a worker remembers, twice over.
SHARD_TEXT, REMEMBERED = 16 << 20, 500_000
_NO_ID, _TABLE = 1 << 55, 1 << 16
#: Characters of which all versions of Unicode say the same and that no normal form changes: ASCII, Latin
#: letters up to U+017F whose small forms are among them, and some marks.
_KNOWN = re.compile("[\t\n\r -~¡«»¿À-ÖØ-öø-įı-ſ–—‘’“”…€]*")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-z0-9ß-öø-ſ]+")
_WORD = re.compile("[^\x20\x09-\x0D]+")


def model_path(name: str = MODEL) -> str:
    """Where a public vocabulary lies; the same place on the driver and on every executor."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the
    others in order from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Known(dict):
    """Parts and the bytes of their ids, worked out when first asked for. A full table makes way for a new
    one, which takes over from it what is met again."""

    def __init__(self, ids: Callable[[str], bytes], most: int, before: dict | None = None):
        super().__init__()
        self.ids, self.most, self.before = ids, most, dict(before or ())

    def __missing__(self, part: str) -> bytes:
        known = self.before.get(part)
        self[part] = known = self.ids(part) if known is None else known
        return known


class Encoder:
    """Texts to the little-endian bytes of their ids."""

    def __init__(self, model: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(model)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide, self.kind = (2, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (4, "I")
        self.known = Known(self._ids, remembered)

    def parts(self, text: str | None) -> list[str]:
        """What the tokenizer's own pattern finds in the text in small letters; a word with a character that
        is not a known one stays a whole, and a text with a special token's string too."""
        if not text:
            return []
        if _KNOWN.fullmatch(text):
            return [text] if any(s in text for s in self.special) else _PART.findall(text.lower())
        if any(s in text for s in self.special):
            return [text]
        return [p for w in _WORD.findall(text) for p in (_PART.findall(w.lower()) if _KNOWN.fullmatch(w) else [w])]

    def _ids(self, part: str) -> bytes:
        if _KNOWN.fullmatch(part) and _PART.fullmatch(part):
            ids = [t.id for t in self.model.tokenize(part if part.isascii() else "".join([self.letters[b] for b in part.encode()]))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return array(self.kind, ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for t in texts:
            if len(self.known) > self.known.most:
                self.known = Known(self._ids, self.known.most, self.known)
            out.append(b"".join(map(self.known.__getitem__, self.parts(t))))
        return out


@lru_cache(maxsize=1)
def _encoder(model: str) -> Encoder:
    return Encoder(model)


def _layout(model: str, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard's file as runs of bytes, each without the zero byte that ends it."""
    encoder = _encoder(model)
    wide, tail = encoder.wide, array(encoder.kind, [end]).tobytes()[:-1]
    ids, places, total = [], [], 0
    for b in slices(batches):
        runs = encoder.encode(b.column("text").to_pylist())
        size = np.fromiter(map(len, runs), np.int64, len(runs)) // wide + 1
        ids.append(np.array(b.column("doc_id").fill_null(0)))
        places.append((total + np.cumsum(size) - size) | np.where(np.array(b.column("doc_id").is_null()), _NO_ID, 0))
        total += int(size.sum())
        yield pa.record_batch([pa.array([r + tail for r in runs], pa.binary())], ["value"])
    if not ids:
        return
    table = np.stack([np.concatenate(ids), np.concatenate(places)], axis=1).astype("<i8")
    padding = -total * wide % 8
    runs = [bytes(padding - 1)] if padding else []
    runs += [table[at:at + _TABLE].tobytes()[:-1] for at in range(0, len(table), _TABLE)]
    runs.append(np.array([len(table), total * 8 + wide], "<u8").tobytes()[:-1])
    yield pa.record_batch([pa.array(runs, pa.binary())], ["value"])


class Shard:
    """One file in memory-mapped arrays."""

    def __init__(self, buffer):
        self.n_docs, last = map(int, np.frombuffer(buffer, "<u8", 2, len(buffer) - 16))
        self.n_ids = last // 8
        self.ids = np.frombuffer(buffer, f"<u{last % 8}", self.n_ids)
        table = np.frombuffer(buffer, "<i8", 2 * self.n_docs, len(buffer) - 16 - 16 * self.n_docs).reshape(-1, 2)
        self.doc_id, self.no_id = table[:, 0], table[:, 1] & _NO_ID > 0
        self.start = np.append(table[:, 1] & (_NO_ID - 1), self.n_ids)


def _mapped(content: bytes) -> mmap.mmap:
    """A task's own copy of a file's bytes, mapped; it goes with the task."""
    with tempfile.TemporaryFile() as f:
        f.write(content)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        counts = np.array([np.frombuffer(x, "<u8", 2) for x in b.column("footer").to_pylist()], np.int64).reshape(-1, 2)
        yield pa.record_batch([b.column("shard"), pa.array(counts[:, 0].copy()), pa.array(counts[:, 1] // 8)], ["shard", "n_docs", "n_ids"])


def _documents(with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        shard = Shard(_mapped(b.column("content")[0].as_py()))
        for at in range(0, shard.n_docs, 4096):
            to = min(at + 4096, shard.n_docs)
            start = shard.start[at:to + 1]
            crc = [zlib.crc32(shard.ids[x:y].astype("<u4")) for x, y in zip(start[:-1], start[1:])]
            out = [pa.array(np.full(to - at, b.column("shard")[0].as_py(), np.int64)), pa.array(np.arange(at, to)), pa.array(shard.doc_id[at:to].copy(), mask=shard.no_id[at:to]),
                   pa.array(start[:-1].copy()), pa.array(np.diff(start)), pa.array(crc, pa.int64())]
            names = ["shard", "place", "doc_id", "local", "n_tokens", "ids_crc32"]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array((start - start[0]).astype(np.int32)), pa.array(shard.ids[start[0]:start[-1]].astype(np.int64))))
                names.append("ids")
            yield pa.record_batch(out, names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").load(f"{path}/shards").filter("length > 0")
            .select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content"))


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", model: str | None = None, end: int = END, shard_text: int = SHARD_TEXT) -> None:
    """Write ``path``/shards and ``path``/manifest (shard, n_docs, n_ids, base) from whole texts.

    Documents lie in ascending order of doc_id, those without one last; rows that repeat an id follow
    each other as they were read. Null and empty texts hold their end id alone. An empty table gives no
    shard. ``shard_text`` is the average size of a shard's texts; a file must stay under 2 GB. The end id
    is under 256."""
    if not 0 <= end < 256:
        raise ValueError("the end id must be under 256")
    spark = docs.sparkSession
    base = columns(docs, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id())
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    dealt = base.repartitionByRange(max(1, -(-size // shard_text)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    (dealt.mapInArrow(partial(_layout, model or model_path(), end), "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\0").option("compression", "none").text(f"{path}/shards"))
    footers = cut(_files(spark, path).select("shard", F.substring("content", -16, 16).alias("footer")).mapInArrow(_footers, "shard long, n_docs long, n_ids long"), "token-footers")
    running_total(footers, [], ["shard"], "n_ids").select("shard", "n_docs", "n_ids", (F.col("upto") - F.col("n_ids")).cast("long").alias("base")).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 for every document, from the
    files; ``ids`` adds the ids themselves."""
    names = "shard long, place long, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    docs = _files(spark, path).mapInArrow(partial(_documents, ids), names)
    bases = spark.read.parquet(f"{path}/manifest").select("shard", "base")
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Write the documents' token files to the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch(spark, "token-files")
    write(docs, path, **how)
    return read(spark, path)
