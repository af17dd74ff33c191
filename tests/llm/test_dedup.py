"""Exact, near and string duplicates, and the archives, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracehold.llm import golomb_dedup, simhash_bktree, suffix_dedup, warc_chunks
from tracehold.llm.common import table

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


# ---- strings that repeat

def brute_repeats(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p:p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if seen[r[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((i, len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeats(df, **kw):
    return Counter(tuple(r) for r in suffix_dedup.without_repeats(df, **kw).drop("kept").collect())


@pytest.mark.parametrize("group,task", [(1 << 16, 20_000), (2, 50)])
def test_repeats_of_the_given_texts(spark, group, task):
    df = table(spark, SF, "documents").limit(120)
    assert repeats(df, group=group, task=task) == brute_repeats(pairs(df), 200)


@pytest.mark.parametrize("group,task", [(1 << 16, 20_000), (3, 40)])
def test_repeats_of_few_letters(spark, group, task):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(200)] + [(900, "a" * 100), (901, "a" * 50), (902, None), (904, "xyz" * 20), (904, "xyz" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats(df, length=12, gram=4, group=group, task=task) == brute_repeats(rows, 12)


def test_repeats_of_odd_rows(odd, empty):
    assert repeats(odd) == brute_repeats(pairs(odd), 200)
    assert not repeats(empty)


def test_repeats_of_one_row_many_times(spark):
    rnd = random.Random(5)
    text, other = ("".join(rnd.choice("abcdefgh ") for _ in range(1000)) for _ in range(2))
    rows = [(None if i % 3 else 7, text) for i in range(2000)] + [(8, other + text[300:700]), (9, other[:150] + text[:120])]
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute_repeats(rows, 200)


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    raw = bytes(random.Random(1).choices(b"abcd ", k=9000))
    whole = suffix_dedup.Anchors(200, 32)(raw)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    suffix_dedup._powers.cache_clear()
    parts = suffix_dedup.Anchors(200, 32)(raw)
    suffix_dedup._powers.cache_clear()
    assert all((x == y).all() for x, y in zip(whole, parts))


def test_columns_are_a_sorted_collection():
    """Orders and common prefixes of every column, against sorting the suffixes."""
    rnd = np.random.default_rng(5)
    symbols = rnd.integers(0, 3, (30, 40)).astype(np.uint16)
    for col, order, prefix in suffix_dedup.columns_of(symbols, 12):
        suffixes = [symbols[col:, i].tolist() for i in order]
        assert suffixes == sorted(suffixes)
        for a, b, p in zip(suffixes, suffixes[1:], prefix[1:]):
            common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
            assert p == min(common, 12)


# ---- exact

def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = defaultdict(list)
    for n, (i, t) in zip(norm, rows):
        groups[n].append((-len(t or ""), i is None, i))
    keep = {n: min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2] for n, g in groups.items()}
    return Counter((i, keep[n], len(groups[n]), i == keep[n], hashlib.sha256(n.encode()).hexdigest()) for n, (i, _) in zip(norm, rows))


def test_exact_duplicates(spark, odd, empty):
    got = lambda df: Counter(tuple(r) for r in golomb_dedup.exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got(odd) == brute_exact(pairs(odd))
    assert not got(empty)


def test_exact_duplicates_with_small_lists(spark, monkeypatch):
    """Many lists for each owner change nothing."""
    rows = [(i, f"text {i % 37}") for i in range(300)]
    fps = spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("text").alias("fp")).union(spark.range(50).select(F.xxhash64("id").alias("fp"))).repartition(9)
    assert golomb_dedup.suspects(fps, 350 * golomb_dedup.PER_OWNER).count() == 37


def test_a_hot_fingerprint_is_listed_twice(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    fps = df.select(F.xxhash64("text").alias("fp"))
    sent = [golomb_dedup._decoded(r) for r in fps.mapInArrow(partial(golomb_dedup._send, 4), golomb_dedup._LISTS).collect()]
    assert max(Counter(np.concatenate(sent).tolist()).values()) == 2 * 4 and sum(map(len, sent)) == 10_000 + 8
    assert [r.group_size for r in golomb_dedup.exact_duplicates(df).filter("kept AND group_size > 1").collect()] == [20_000]


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_golomb_round_trip(n):
    rnd = np.random.default_rng(n)
    v = np.sort(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    v[n // 2:n // 2 + 2] = v[n // 2]
    k, first, unary, low = golomb_dedup.encode(v)
    assert (golomb_dedup.decode(n, k, first, unary, low) == v).all()
    if n == 1000:
        assert len(unary) + len(low) < 8 * n * 0.9


# ---- near

def brute_near(rows):
    def fingerprint(t):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    fps = [fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)] += [d] if d is not None else []
    return Counter((d, f"{f:016x}", min(least[top(i)], default=None)) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def near(df, **kw):
    return Counter(tuple(r) for r in simhash_bktree.near_duplicates(df, **kw).select("doc_id", "fingerprint", "component_id").collect())


def test_near_duplicates(spark, odd, empty):
    assert near(odd) == brute_near(pairs(odd))
    assert not near(empty)


def test_near_duplicates_of_the_given_texts(spark):
    df = table(spark, SF, "documents")
    assert near(df) == brute_near(pairs(df))


def test_links_of_crowded_buckets(spark):
    """Buckets over the shard size are dealt out finer and lose no link."""
    rnd = random.Random(2)
    fps = {0x1234 << 48 | 0x5678 << 32 | rnd.randrange(1 << 14) for _ in range(150)} | {rnd.randrange(1 << 64) for _ in range(50)}
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = defaultdict(set)
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 2:
                want[a].add(b)
    for shard in (1024, 4):
        got = simhash_bktree.components(simhash_bktree.links(nodes, shard=shard)).collect()
        label = {r["node"] & (1 << 64) - 1: r["label"] for r in got}
        assert set(label) == set(want) and all(label[a] == label[b] for a in want for b in want[a])


def test_tree_finds_all_within_a_radius():
    rnd = random.Random(4)
    values = list(dict.fromkeys(rnd.randrange(1 << 16) for _ in range(400)))
    tree = simhash_bktree.BKTree(values[0])
    for v in values[1:]:
        tree.add(v)
    for q in values[:50]:
        assert {tree.values[i] for i in tree.within(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


# ---- archives

PAGES = "page_id long, url string, html string, sha1 string, chunk int"


def test_archives(spark):
    big = "<p>\r\n\r\nWARC/1.1\r\n" + "é" * 90_000 + "</p>\r\n"
    html = [(1, "a" * 999), (2, "a" * 999), (3, "b" * 1000), (4, "b" * 1000), (9, "b" * 1000), (5, None), (6, ""), (7, big), (8, big), (None, "b" * 1000), (10, "x\r\n"), (10, "x\r\n"), (11, "\r\n")]
    df = spark.createDataFrame([(i, None if i == 5 else f"http://e/{i} x", h, "s", 1) for i, h in html], PAGES)
    want = Counter()
    for i, h in html:
        raw = (h or "").encode()
        last = max(j for j, g in html if (g or "") == (h or "") and j is not None)
        revisit = len(raw) >= 1000 and i != last
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None] += 1
    assert Counter(tuple(r) for r in warc_chunks.archive_round_trip(df).collect()) == want
    assert warc_chunks.archive_round_trip(df.limit(0)).count() == 0


def test_chunks_cut_no_character_and_carry_the_digest():
    raw = ("aé🎉" * 50).encode()
    at = 0
    for piece, sha1, last in warc_chunks.chunked(raw, 7):
        bytes(piece).decode()
        at += len(piece)
        assert sha1 == hashlib.sha1(raw[:at]).hexdigest() and last == (at == len(raw)) and len(piece) <= 7


def test_archive_is_plain_warc(spark, tmp_path):
    """Headers, lengths and record ends are where the format wants them."""
    import gzip
    df = spark.createDataFrame([(1, "http://e/1", "x" * 70_000), (2, "http://e/2", "hello")], "page_id long, url string, html string").coalesce(1)
    warc_chunks.write_archives(df, str(tmp_path / "a"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part-*")))
    records = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[n:n + 4] == b"\r\n\r\n"
        data, records = rest[n + 4:], records + 1
    assert records == 2
