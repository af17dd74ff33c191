"""How far each source of a language departs from the language and from its other sources.

A language keeps the terms that at least ``DOCS`` of its documents hold. Its sorted terms are dealt to
shards by range, and each shard becomes a minimal acyclic transducer: an automaton of bytes in which equal
endings are one state, and whose edges carry how many terms lie before them, so the sum along a term's path
is its ordinal, its place among the sorted terms. A shard's base, the terms of the language before it, is a
prefix sum over the shards.

Texts are then read once more and streamed through the transducers: a batch of texts of one source is
thinned to its different terms and how often each occurs, in order, and the run is cut at the shards' first
terms; each shard walks the runs sent to it, all terms at once byte by byte, and adds up by ordinal. Terms
that were not kept fall out of the automaton. Everything after it is by ordinal: counts, probabilities, and
the order of equal values. A shard holds about ``SHARD`` terms whatever the vocabulary's size, and its runs
are dealt out over several tasks.

Divergences of two sources need each kept term of both. Most terms are in neither; what such a term adds is
one number for the pair, so only terms that occur are summed as departures from it, in blocks of ordinals
and of sources: work grows with the kept terms that occur, and the answer has a row for each pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.llm.common import as_bytes, columns, cut, partitions, slices

DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Terms of a shard, different terms that a task holds before it sends them on, ordinals and sources of a block.
SHARD, HELD, BLOCK, SOURCES = 1 << 13, 500_000, 1 << 12, 32
#: Entries of runs that a task walks, on average, and the pieces of shards that are dealt to a task.
TASK, GROUPS = 1 << 22, 4
#: Letters A to Z as small ones, everything that is not part of a term as a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in UTF-8, only A-Z in lower case."""
    return as_bytes(text).translate(_FOLD).split()


class Transducer:
    """The minimal acyclic transducer of sorted distinct byte strings. ``key`` holds each edge as its state
    times 256 and its byte, sorted; ``to`` the state it leads to, ``skip`` the terms before it in its state;
    ``final`` marks states where a term ends."""

    def __init__(self, key: np.ndarray, to: np.ndarray, skip: np.ndarray, final: np.ndarray, root: int):
        self.key, self.to, self.skip, self.final, self.root = key, to, skip, final, root

    @classmethod
    def build(cls, words: list[bytes]) -> Transducer:
        """Words come in order: once the next word leaves a branch, nothing can be added to it, so its
        states are looked up among the finished ones, from its end backwards."""
        finished: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        sizes: list[int] = []
        open_states = [[False, []]]  # the path of the last word: whether a term ends, and its finished edges
        path = b""

        def finish(depth: int) -> None:
            while len(open_states) > depth + 1:
                end, edges = open_states.pop()
                state = (end, tuple(edges))
                at = finished.get(state)
                if at is None:
                    at = finished[state] = len(states)
                    states.append(state)
                    sizes.append(end + sum(sizes[t] for _, t in edges))
                open_states[-1][1].append((path[len(open_states) - 1], at))

        for word in words:
            common, most = 0, min(len(path), len(word))
            while common < most and path[common] == word[common]:
                common += 1
            finish(common)
            path = word
            open_states.extend([False, []] for _ in range(len(word) - common))
            open_states[-1][0] = True
        finish(0)
        root = len(states)
        states.append((open_states[0][0], tuple(open_states[0][1])))
        key, to, skip = [], [], []
        for s, (end, edges) in enumerate(states):
            before = int(end)
            for byte, t in edges:
                key.append(s << 8 | byte), to.append(t), skip.append(before)
                before += sizes[t]
        return cls(np.array(key, np.int64), np.array(to, np.int64), np.array(skip, np.int64), np.array([end for end, _ in states], bool), root)

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """The edges by state and byte, -1 for none; bytes that no term holds share one column."""
        used, column = np.unique(self.key & 255, return_inverse=True)
        of = np.full(256, len(used))
        of[used] = np.arange(len(used))
        table = np.full((len(self.final), len(used) + 1), -1, np.int32)
        table[self.key >> 8, column] = np.arange(len(self.key))
        return of, table

    def ordinals(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word among the terms, -1 for one that is none of them. Word i is the bytes of
        ``text`` from ends[i] to ends[i + 1]; all words are walked at once, a byte a step."""
        of, table = self._table
        column, ends = of.astype(np.int16)[text[ends[0]:ends[-1]]], ends - ends[0]  # the text may hold much else
        out, skip, to, width = np.full(len(ends) - 1, -1, np.int64), self.skip, self.to, table.shape[1]
        word, at, end = np.arange(len(ends) - 1), ends[:-1].astype(np.int64), ends[1:].astype(np.int64)
        state, before = np.full(len(word), self.root), np.zeros(len(word), np.int64)
        while len(word):
            over = at == end
            if over.any():
                whole = over & self.final[state]
                out[word[whole]] = before[whole]
                left = np.flatnonzero(~over)
                word, at, end, state, before = (x.take(left) for x in (word, at, end, state, before))
            edge = table.take(state * width + column.take(at))
            known = edge >= 0
            if not known.all():
                left = np.flatnonzero(known)
                word, at, end, before, edge = (x.take(left) for x in (word, at, end, before, edge))
            before = before + skip.take(edge)
            state, at = to.take(edge), at + 1
        return out

    def places(self, words: list[bytes]) -> np.ndarray:
        return self.ordinals(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))

    def to_bytes(self) -> bytes:
        return np.array([len(self.key), len(self.final), self.root], "<i4").tobytes() + b"".join(x.astype("<i4").tobytes() for x in (self.key, self.to, self.skip, self.final))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        edges, _, root = map(int, np.frombuffer(raw, "<i4", 3))
        key, to, skip, final = np.split(np.frombuffer(raw, "<i4", offset=12).astype(np.int64), [edges, 2 * edges, 3 * edges])
        return cls(key, to, skip, final.astype(bool), root)


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's documents hold each term, by language."""
    held: dict[str, Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.record_batch([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "term", "docs"])

    for b in slices(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            held.setdefault(lang, Counter()).update(set(terms(text)))
        if sum(map(len, held.values())) > HELD:
            yield from sent()
            held.clear()
    yield from sent()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts as sorted runs of their different terms and counts, one a source at a time."""
    held: dict[tuple, Counter] = {}
    at, serial = TaskContext.get().partitionId(), 0

    def sent() -> Iterator[pa.RecordBatch]:
        nonlocal serial
        for (lang, source), counts in held.items():
            found = sorted(counts)
            serial += 1
            times = np.fromiter(map(counts.__getitem__, found), np.int64, len(found))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), x) for x in (pa.array(found, pa.binary()), pa.array(times))]
            yield pa.record_batch([pa.array([lang]), pa.array([source]), pa.array([at * 1_000_003 + serial]), *lists], ["lang", "source", "run", "terms", "counts"])

    for b in slices(batches):
        for lang, source, text in zip(*[b.column(c).to_pylist() for c in ("lang", "source", "text")]):
            found = terms(text)
            if found:
                held.setdefault((lang, source), Counter()).update(found)
        if sum(map(len, held.values())) > HELD:
            yield from sent()
            held.clear()
    yield from sent()


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs cut at the first terms of their language's shards."""
    for b in slices(batches, 1):
        found, counts, shards = b.column("terms").flatten(), b.column("counts").flatten(), b.column("shards")[0].as_py()
        ends = np.array([0, *[bisect_left(range(len(found)), s["first"], key=lambda i: found[i].as_py()) for s in shards[1:]], len(found)], np.int32)
        some = pa.array(np.diff(ends) > 0)
        same = [pa.array([b.column(c)[0].as_py()] * len(shards), b.schema.field(c).type) for c in ("lang", "run", "source")]
        of = [pa.array([s[c] for s in shards], pa.int64()) for c in ("shard", "n", "base")]
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (found, counts)]
        yield pa.record_batch([*same, *of, *lists], ["lang", "run", "source", "shard", "n", "base", "terms", "counts"]).filter(some)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    words = sorted(t.encode() for t in group["term"])
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "shard": [int(group["shard"].iloc[0])], "first": [words[0]], "n": [len(words)], "fst": [Transducer.build(words).to_bytes()]})


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, its transducer first, then its runs by source: counts by ordinal for each source."""
    fst, base, source, counts = None, 0, None, None

    def sent() -> Iterator[pa.RecordBatch]:
        if source is not None:
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([source[0]] * len(some), pa.string()), pa.array([source[1]] * len(some), pa.string()), pa.array(base + some), pa.array(counts[some])], ["lang", "source", "ordinal", "n"])

    for b in slices(batches, 64):
        lists, numbers = b.column("terms"), b.column("counts")
        words, each = lists.values, numbers.values.to_numpy()
        _, ends, text = words.buffers()
        ends, text = np.frombuffer(ends, np.int32)[words.offset:] if len(words) else None, np.frombuffer(text or b"", np.uint8)
        spans, froms = lists.offsets.to_numpy(), numbers.offsets.to_numpy()
        keys = b.select(["lang", "source", "n", "base"]).to_pylist()
        for i, key in enumerate(keys):
            if b.column("fst")[i].is_valid:
                yield from sent()
                fst, base, source = Transducer.from_bytes(b.column("fst")[i].as_py()), key["base"], None
                continue
            if source != (key["lang"], key["source"]):
                yield from sent()
                source, counts = (key["lang"], key["source"]), np.zeros(key["n"], np.int64)
            at = fst.ordinals(text, ends[spans[i]:spans[i + 1] + 1])
            known = np.flatnonzero(at >= 0)
            counts[at.take(known)] += each[froms[i]:froms[i + 1]].take(known)  # a run holds a term once
    yield from sent()


def _groups(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    base = columns(docs, text=text, lang=lang, source=source)
    return base.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def vocabulary(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = DOCS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Two written tables: lang, term, shard of the kept terms; and lang, shard, first, n, fst, base of the
    shards, whose transducers give a term's place in its shard."""
    base = _groups(docs, text, lang, source)
    kept = base.select("lang", "text").mapInArrow(_occurring, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = cut(kept.select("lang", "term"), "audit-kept")
    n = max(1, -(-kept.count() // shard))
    dealt = cut(kept.repartitionByRange(n, "lang", "term").withColumn("shard", F.spark_partition_id().cast("long")), "audit-terms")
    built = dealt.groupBy("lang", "shard").applyInPandas(_build, "lang string, shard long, first binary, n long, fst binary")
    before = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    built = cut(built, "audit-built")
    bases = built.select("lang", "shard", "n").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")).drop("n")
    return dealt, cut(built.join(bases, ["lang", "shard"]), "audit-shards")


def recount(docs: DataFrame, shards: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, ordinal, n: how often each kept term that occurs in a source occurs there, the texts
    streamed through the transducers."""
    spark = docs.sparkSession
    runs = cut(_groups(docs, text, lang, source).mapInArrow(_runs, "lang string, source string, run long, terms array<binary>, counts array<long>"), "audit-runs")
    of = cut(shards.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("shard", "first", "n", "base"))).alias("shards")), "audit-firsts")
    n, held = shards.count(), runs.agg(F.sum(F.size("counts"))).first()[0] or 0
    tasks = max(partitions(spark), -(-held // TASK))
    salts = max(1, -(-GROUPS * tasks // max(1, n)))
    sent = runs.join(of, "lang").mapInArrow(_cut_runs, "lang string, run long, source string, shard long, n long, base long, terms array<binary>, counts array<long>")
    sent = sent.withColumn("salt", F.pmod("run", F.lit(salts))).withColumn("fst", F.lit(None).cast("binary")).drop("run")
    machines = shards.select("lang", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("array<binary>").alias("terms"), F.lit(None).cast("array<bigint>").alias("counts"), "n", "base", "fst")
    laid = sent.unionByName(machines).repartition(tasks, "lang", "shard", "salt").sortWithinPartitions("lang", "shard", "salt", F.col("source").asc_nulls_first())
    counted = laid.mapInArrow(_recount, "lang string, source string, ordinal long, n long")
    return cut(counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "audit-counts")


def _departures(group: pa.Table) -> pa.Table:
    """For each two sources of a block of ordinals and two blocks of sources: the divergence summed over the
    terms that occur in the block, less as many times that of a term in neither."""
    t = {c: group.column(c).to_numpy() for c in ("ordinal", "p", "p0", "own", "a", "b")}
    names, source = np.unique(group.column("source").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    ordinals, row = np.unique(t["ordinal"], return_inverse=True)  # the first is -1: every source has one such row
    p0, own = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    p0[source], own[source] = t["p0"], t["own"]
    p = np.tile(p0, (len(ordinals), 1))
    p[row, source] = t["p"]
    a, b, out = t["a"][0], t["b"][0], []
    for i in range(len(names)):
        others = np.flatnonzero((own == (b if own[i] == a else a)) & (np.arange(len(names)) != i))
        if len(others):
            q = p[:, others]
            d = p[:, i][:, None] - q
            each = d * d // q
            out.append((np.full(len(others), i), others, each.sum(axis=0) - len(ordinals) * each[0]))  # row 0 is a term in neither
    one, two, value = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(one), pa.string()), "source": pa.array(names[one].tolist(), pa.string()), "item": pa.array(names[two].tolist(), pa.string()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = DOCS, top: int | None = TOP, shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value and rank for every group of a language and a source that occurs.

    Part ``pair`` has every other source of the language, value the divergence of the group from it over all
    kept terms; part ``term`` has the ``top`` terms (None: all) that the group uses more than its language,
    value what each adds to the divergence from it. With counts raised by one, probabilities are whole parts
    of ``UNIT``. Ranks go by value, largest first, then by the item's bytes.

    Null texts, languages and sources count as empty strings. Each row is a document, so a repeated row counts
    again. A language without kept terms has pairs of value zero and no terms; a table without rows gives none."""
    dealt, shards = vocabulary(docs, text, lang, source, least, shard)
    counts = recount(docs, shards, text, lang, source)
    of_lang = shards.groupBy("lang").agg(F.sum("n").alias("size"))
    share = "cast({0} * (n + 1) div (total + size) as bigint) + 1"
    share = share.format(f"cast({UNIT} as decimal(20,0))")
    groups = _groups(docs, text, lang, source).select("lang", "source").distinct()
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "size"])
    groups = groups.withColumn("n", F.lit(0).cast("long")).withColumn("p0", F.expr(f"CASE WHEN size > 0 THEN {share} ELSE 1 END")).drop("n")
    many = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("blocks"))
    groups = cut(groups.join(many, "lang").withColumn("own", F.pmod(F.xxhash64("source"), "blocks")), "audit-groups")
    counts = cut(counts.join(groups, ["lang", "source"]).withColumn("p", F.expr(share)).select("lang", "source", "ordinal", "n", "p"), "audit-shares")

    everywhere = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("size").alias("size"))
    everywhere = everywhere.join(totals, "lang").select("lang", "ordinal", F.expr(share).alias("q"))
    more = counts.join(everywhere, ["lang", "ordinal"]).filter("p > q").select("lang", "source", "ordinal", F.expr("(p - q) * (p - q) div q").alias("value"))
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal"))
    more = more.withColumn("rank", best)
    more = more if top is None else more.filter(F.col("rank") <= top)
    place = F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1
    names = dealt.withColumn("place", place).join(shards.select("lang", "shard", "base"), ["lang", "shard"]).select("lang", (F.col("base") + F.col("place")).alias("ordinal"), F.col("term").alias("item"))
    found = more.join(names, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    left = groups.filter("size > 0").select("lang", "source", "p0", "own", "blocks", "size")
    here = left.withColumn("ordinal", F.lit(-1).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {BLOCK}")))).withColumn("p", F.col("p0")).drop("size")
    there = counts.join(left.drop("size"), ["lang", "source"]).withColumn("block", F.expr(f"ordinal div {BLOCK}")).drop("n")
    sides = there.unionByName(here).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    apart = sides.select("lang", "block", "a", "b", "source", "own", "ordinal", "p", "p0").groupBy("lang", "block", "a", "b").applyInArrow(_departures, "lang string, source string, item string, value long")
    apart = apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    two = groups.select("lang", "source", "p0", "size").join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").filter("source <> item")
    pairs = two.join(apart, ["lang", "source", "item"], "left").withColumn("value", F.expr("size * ((p0 - q0) * (p0 - q0) div q0) + coalesce(more, 0)"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return found.unionByName(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")))
