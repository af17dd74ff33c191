"""Divergence of sources, token files and ranked search, against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracehold.llm import pair_maxscore, source_audit, token_files
from tracehold.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(n, seed=1, words=40):
    """Invented texts with frequent and rare words, mixed case, digits, accents and marks; a third in one source."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("aàbBcé日", k=rnd.randrange(1, 5))) for _ in range(words)] + ["the", "The", "x1", "7"]
    return [(None if i % 17 == 0 else i // 2, None if i % 11 == 0 else " ,".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rnd.randrange(0, 60))),
             None if i % 13 == 0 else "ab"[i % 2], f"s{rnd.choice([0, 0, 0, 1, 2, 3, 4])}") for i in range(n)]


def plain_audit(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))) for _, text, lang, source in rows]
    holding, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        holding[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = sorted((w for w, n in holding[lang].items() if n >= least), key=str.encode)
        groups = sorted({s for g, s, _ in docs if g == lang})

        def share(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (total + len(kept)) for w in kept}

        p = {s: share(counts[lang, s]) for s in groups}
        q = share(sum((counts[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in groups if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def of_audit(df):
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]


@pytest.mark.parametrize("shard,top", [(1 << 15, 200), (5, 3), (1, None)])
def test_audit(spark, monkeypatch, shard, top):
    for name, v in (("BLOCK", 4), ("SOURCES", 2)) if shard < 9 else ():
        monkeypatch.setattr(source_audit, name, v)
    rows = rows_of(300)
    got = of_audit(source_audit.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), shard=shard, top=top))
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, top=top)


def test_audit_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    got = of_audit(source_audit.audit(odd))
    assert set(got) == plain_audit(rows) and len(got) == len(set(got))
    assert source_audit.audit(empty).count() == 0
    none_kept = spark.createDataFrame([(1, "one two", "x", "b"), (2, "three", "x", "a"), (3, None, "y", "a")], SCHEMA)
    assert of_audit(source_audit.audit(none_kept)) == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]


def test_ordinals():
    words = sorted({f"w{i}".encode() for i in range(2000)} | {"été".encode(), b"w", b"w1x"})
    fst = source_audit.Transducer.from_bytes(source_audit.Transducer.build(words).to_bytes())
    assert fst.places(words).tolist() == list(range(len(words)))
    assert fst.places([b"", b"w10000", b"x", b"w1", words[-1] + b"e"]).tolist() == [-1, -1, -1, words.index(b"w1"), -1]
    assert source_audit.Transducer.build([]).places([b"a", b""]).tolist() == [-1, -1]


def test_equal_endings_are_one_state():
    """As many states as different sets of endings, which makes the automaton minimal."""
    words = sorted(f"{a}{b}ing".encode() for a in "abcdefgh" for b in "xyz") + [b"zing", b"zinged"]
    fst = source_audit.Transducer.build(sorted(words))
    endings = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(fst.final) == len(endings)


def plain_tokens(rows, text_of=lambda r: r[1], id_of=lambda r: r[0]):
    t = Tokenizer.from_file(token_files.model_path())
    ids = [(id_of(r), np.array([*t.encode(text_of(r) or "", add_special_tokens=False).ids, 1], "<u4")) for r in rows]
    return [(i, len(x), zlib.crc32(x.tobytes())) for i, x in ids]


TRICKY = ["it's we'll I'D don't", "a<|endoftext|>b <|startoftext|>", "é<|endoftext|> 日", "¡Ÿ ÑÞſ ×÷ İı — “x”…", "été, señor! ¿qué? «oui»— non…", "x́ é, ≠ ,́", "1234 7kg €5 ½", "\x1cA\x85B C D", "ΣΑΣ İI ǅ", '"" ," "', "日本語。ひらがな、", "a\x00b\x0bc", "a\x07b\x01 \x7f\x1b", "Éa,b Ñandú?! ĲĿŉ ǰa ªº µ ſ ÀÉ’s l’été d'été: it'S 'tis 'REally", "...!? (x) ...", "🎉🎉, 👩‍👩‍👧"]


@pytest.mark.parametrize("shard_text", [60, 1 << 20])
def test_token_files(spark, odd, shard_text):
    rows = [(-5, "first"), (9, ""), *[(r["doc_id"], r["text"]) for r in odd.collect()], *[(100 + i, t) for i, t in enumerate(TRICKY)], *[(1000 - i, t) for i, (_, t, _, _) in enumerate(rows_of(60))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in token_files.round_trip(docs, shard_text=shard_text).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert Counter((i, n, c) for i, _, n, c in got) == Counter(plain_tokens(rows))
    order = [i for i, *_ in got]
    known = [i for i in order if i is not None]
    assert known == sorted(known) and order[:len(known)] == known
    assert [s for _, s, _, _ in got] == np.cumsum([0, *[n for _, _, n, _ in got]])[:-1].tolist()


def test_token_files_give_the_ids(spark, tmp_path, empty):
    docs = table(spark, SF, "documents")
    path = str(tmp_path / "files")
    token_files.write(docs, path, shard_text=50_000)
    assert spark.read.parquet(f"{path}/manifest").count() > 3
    t = Tokenizer.from_file(token_files.model_path())
    ids = {r["doc_id"]: r["ids"] for r in token_files.read(spark, path, ids=True).collect()}
    assert ids == {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    flat = b"".join(p.read_bytes()[:2 * r["n_ids"]] for p, r in zip(sorted((tmp_path / "files/shards").glob("part-*")), spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()))
    assert np.frombuffer(flat, "<u2").tolist() == [i for k in sorted(ids) for i in ids[k]]
    assert token_files.round_trip(empty).count() == 0


def test_the_table_of_words_is_emptied_safely():
    small, t = token_files.Encoder(token_files.model_path(), remembered=20), Tokenizer.from_file(token_files.model_path())
    for at in range(0, 200, 10):
        texts = [text for _, text, _, _ in rows_of(200, seed=3)[at:at + 10]]
        assert small.encode(texts) == [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u2").tobytes() for x in texts]


def plain_search(rows, items, top=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    docs = [(i, Counter(w)) for i, w in ((r[0], find(r[1])) for r in rows) if w]
    n, total, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(w for _, c in docs for w in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(find(text)) if c[w])
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out[item, rank, i, -score] += 1
    return out


ITEMS = [(1, "the x1 aa日 bé a c"), (2, ""), (3, None), (4, "nothing here"), (5, "THE The the"), (5, "7"), (None, "a B c é 日 7")] + [(10 + i, t) for i, (_, t, _, _) in enumerate(rows_of(30, seed=1)) if t]


@pytest.mark.parametrize("shard_text,block,top", [(300, 7, 10), (1 << 20, 1024, 10), (1000, 1024, 2)])
def test_search(spark, monkeypatch, shard_text, block, top):
    monkeypatch.setattr(pair_maxscore, "STRETCH", 4)
    rows = rows_of(400)
    docs, items = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = pair_maxscore.rank(docs, items, shard_text=shard_text, block=block, top=top).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == plain_search(rows, ITEMS, top)


def test_search_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha zeta"), (1, "alpha zeta"), (2, "same row w5x5"), (3, None)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = pair_maxscore.rank(odd, items).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == plain_search(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert pair_maxscore.rank(empty, items).count() == 0 and pair_maxscore.rank(odd, items.limit(0)).count() == 0


def test_pairs_tighten_the_bounds():
    """No document is above its bound, and bounds of pairs add fewer entries than those of terms alone."""
    import pyarrow as pa
    rows = rows_of(3000, words=300)
    batch = pa.record_batch([pa.array(range(len(rows))), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    (shard,) = pair_maxscore._index(1 << 30, iter([batch]))
    n, total = shard.column("n_docs")[0].as_py(), shard.column("n_terms")[0].as_py()
    block = pair_maxscore.Block([t for _, t, _, _ in rows[:200]])
    (df,) = pair_maxscore._holding(block.terms, iter([shard]))
    block.weigh(dict(zip(df.column(0).to_pylist(), df.column(1).to_pylist())), n)
    (lists,) = pair_maxscore._lists(block, n, total, 10, iter([shard]))
    held = pair_maxscore.Lists(block, {c: lists.column(c)[0].as_py() for c in lists.schema.names})
    alone, paired = 0, 0
    for item in block.items:
        whole = np.zeros(n, np.int64)
        for j, t in enumerate(item, 1):
            at = slice(held.starts[t], held.starts[t + 1])
            whole[held.places[at]] += held.scores[at]
            assert (whole <= held.bounds(item)[j][np.arange(n) // pair_maxscore.STRETCH]).all()
        paired += held.rank(item, 0, 10)[1]
        single = pair_maxscore.Lists(block, {c: lists.column(c)[0].as_py() for c in lists.schema.names})
        single.bounds = lambda i: np.concatenate([np.zeros((1, held.most.shape[1]), np.int64), np.cumsum(held.most[i], axis=0)])
        alone += single.rank(item, 0, 10)[1]
    assert paired < alone
