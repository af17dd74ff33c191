"""Models and samplers: held-out accuracy, brute force, exact round trips."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracehold.llm import boosted_quality, kneser_ney, lattice_sampling, ordinal_toxicity
from tracehold.llm.common import table

SF = "/root/testdata/sf0.01"


def held(doc_id, m, at):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m == at


# ---- toxicity

def test_ordinal_orders_thresholds_and_learns():
    rnd = np.random.default_rng(0)
    grades = rnd.integers(0, 4, 600)
    x = [{0: float(g + rnd.normal(0, 0.3)), 1: float(rnd.normal())} for g in grades]
    w, t = ordinal_toxicity.fit_ordinal(x, grades, 2)
    assert (np.diff(t) > 0).all() and w[0] > 3 and abs(w[1]) < w[0] / 5
    predicted = [int((1 / (1 + np.exp(t - w[0] * r[0] - w[1] * r[1])) >= 0.5).sum()) for r in x]
    assert (np.array(predicted) == grades).mean() > 0.8


def test_toxicity_of_unseen_rows(spark):
    docs, labels = table(spark, SF.replace("0.01", "0.1"), "documents"), table(spark, SF.replace("0.01", "0.1"), "labels")
    cut = lambda of: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == of
    model = ordinal_toxicity.fit(docs, labels.filter(~cut(0)))
    assert model.thresholds == sorted(model.thresholds)
    got = ordinal_toxicity.score(docs.filter(cut(0)), model).join(labels, "doc_id").toPandas()
    bad = got[got.toxic == 1]
    assert (bad.p_toxic >= 0.5).mean() > 0.75 and (got[got.toxic == 0].p_toxic < 0.5).mean() > 0.99
    assert (got.severity - got.p_toxic).min() >= -1e-12


def test_toxicity_of_odd_rows(odd, empty, labels):
    model = ordinal_toxicity.fit(odd, labels)
    assert ordinal_toxicity.score(odd, model).count() == 14
    assert ordinal_toxicity.without_toxic(odd, model).columns == odd.columns
    none = ordinal_toxicity.fit(odd, labels.limit(0))
    assert ordinal_toxicity.without_toxic(odd, none).count() == 14
    assert ordinal_toxicity.score(empty, model).count() == 0
    assert ordinal_toxicity.fit(empty, labels).weights == {}


def test_toxicity_fit_of_repeated_ids_and_texts_without_words(spark):
    """Each row counts, whatever its id: a table with every row twice gives the weights of one with ids of
    their own; texts without a word are rows without features, and the rows stay bounded."""
    texts = [(i, f"vile{i % 3} awful common" if i % 4 == 0 else f"kind{i % 5} common") for i in range(120)] + [(200, ""), (201, None), (202, "-- !"), (203, "")]
    labels = [(i, int(i % 4 == 0)) for i, _ in texts]
    once = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    twice = ordinal_toxicity.fit(once.unionByName(once), marks)
    apart = ordinal_toxicity.fit(once.unionByName(once.withColumn("doc_id", F.col("doc_id") + 1000)), marks.unionByName(marks.withColumn("doc_id", F.col("doc_id") + 1000)))
    assert twice.weights.keys() == apart.weights.keys() and twice.weights["awful"] > 0
    assert np.allclose([twice.weights[f] for f in sorted(twice.weights)], [apart.weights[f] for f in sorted(twice.weights)], atol=1e-6)
    assert np.allclose(twice.thresholds, apart.thresholds, atol=1e-6)
    assert ordinal_toxicity.without_toxic(once, twice).count() == 120 - 30 + 4
    bounded = ordinal_toxicity.fit(once.unionByName(once).unionByName(once), marks, rows=124)
    assert bounded.weights["awful"] > 0


# ---- quality

def test_flat_trees_walk_like_nested_ones():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosted_quality.fit_trees(x, y, trees=20, depth=3)
    inner = model.features.shape[1]

    def walk(row):
        total = model.start
        for f, t, v in zip(model.features, model.thresholds, model.values):
            at = 0
            while at < inner:
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - inner]
        return 1 / (1 + math.exp(-total))
    got = model.score(x)
    assert np.allclose(got, [walk(r) for r in x]) and ((got > 0.5) == y).mean() > 0.95


def test_quality_of_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = boosted_quality.fit(docs, boosted_quality.training_labels(labels))
    got = boosted_quality.score(docs, model).join(labels, "doc_id").toPandas()
    assert (got.held_out == [held(i, 5, 0) for i in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.93 and ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_quality_of_odd_rows(odd, empty, labels):
    model = boosted_quality.fit(odd, labels)
    rows = boosted_quality.score(odd, model).collect()
    assert len(rows) == 14 and all(0 <= r["score"] <= 1 for r in rows)
    assert boosted_quality.score(empty, model).count() == 0
    assert {r["score"] for r in boosted_quality.score(odd, boosted_quality.fit(odd, labels.limit(0))).collect()} == {0.5}


def test_quality_ignores_what_it_must(odd, labels):
    model = boosted_quality.fit(odd, labels)
    other = odd.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")).withColumn("doc_id", F.col("doc_id") + 100)
    score = lambda df: sorted(r["score"] for r in boosted_quality.score(df, model).collect())
    assert score(odd) == score(other)


# ---- segmentations

@pytest.fixture(scope="module")
def sampler():
    return lattice_sampling.Sampler(lattice_sampling.MODEL, 3)


def all_paths(net, text):
    """Every segmentation of a text and its probability."""
    words = lattice_sampling.units(text)
    net.learn(words)

    def of(state):
        if state < 0:
            return [((), 0.0)]
        return [((int(net.piece[e]), *p), float(net.logp[e]) + w) for e in range(net.start[state], net.start[state + 1]) for p, w in of(int(net.next[e]))]
    out = {}
    for parts in itertools.product(*[of(net.first[u]) for u in words]):
        out[tuple(i for p, _ in parts for i in p)] = sum(w for _, w in parts)
    return out


def test_samples_are_gumbel_top_k(sampler):
    """The first two samples' frequencies against sampling without replacement, and the inclusion scores."""
    paths = {k: math.exp(v) for k, v in all_paths(sampler.net, "the cat").items()}
    assert abs(sum(paths.values()) - 1) < 1e-9
    n = 6000
    first, pair, inclusion = Counter(), Counter(), defaultdict(float)
    for i, rank, s in sampler.sample(list(range(n)), ["the cat"] * n):
        key = tuple(s[3].tolist())
        assert abs(s[0] - math.log(paths[key])) < 1e-6
        if rank == 1:
            first[key] += 1
            last = key
        elif rank == 2:
            pair[last, key] += 1
        inclusion[key] += math.exp(-s[2])  # one over the inclusion probability: its mean is one
    for k, p in paths.items():
        assert abs(first[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        for j, q in paths.items():
            if j != k:
                e = p * q / (1 - p)
                assert abs(pair[k, j] / n - e) < 5 * math.sqrt(e * (1 - e) / n) + 1e-3
        if p > 0.02:
            assert abs(inclusion[k] / n - 1) < 0.15


def test_samples_are_distinct_and_complete(sampler):
    for text in ("a", "of", "é"):
        paths = all_paths(sampler.net, text)
        got = [tuple(s[3].tolist()) for _, _, s in sampler.sample([5], [text])]
        assert len(got) == len(set(got)) == min(3, len(paths)) and set(got) <= set(paths)


def test_samples_do_not_depend_on_batches(sampler):
    texts = ["some words here", "", None, "x" * 400, "日本 ▁ 🎉\n\n  two  spaces "]
    together = [(i, r, s[0], s[3].tolist()) for i, r, s in sampler.sample([7, 8, 9, 10, 11], texts)]
    alone = [(k, r, s[0], s[3].tolist()) for k, (key, t) in enumerate(zip([7, 8, 9, 10, 11], texts)) for _, r, s in lattice_sampling.Sampler(lattice_sampling.MODEL, 3).sample([key], [t])]
    assert together == alone


def test_what_lattices_remember(monkeypatch):
    """Words that come twice are not remembered, those that come thrice are; forgetting changes no sample."""
    rnd = random.Random(4)
    texts = [" ".join(["often", *rnd.choices([f"w{i}" for i in range(300)], k=20)]) for _ in range(300)]
    plain = lattice_sampling.Sampler(lattice_sampling.MODEL, 2)
    want = [(i, r, s[0], s[3].tolist()) for i, r, s in plain.sample(list(range(300)), texts)]
    monkeypatch.setattr(lattice_sampling, "REMEMBERED", 500)
    small = lattice_sampling.Sampler(lattice_sampling.MODEL, 2)
    assert [(i, r, s[0], s[3].tolist()) for i, t in enumerate(texts) for _, r, s in small.sample([i], [t])] == want
    net = lattice_sampling.Sampler(lattice_sampling.MODEL, 2).net
    for times in range(3):
        assert net.learn([" twice", " other", " twice"]).tolist()[0] == net.first[" twice"]
        net.learn([f" else{times}"])
        assert (" twice" in net.first) == (times == 2)


def test_parts_of_words_are_worked_out_once():
    """A word is not worked out again for each mark, line end or odd character that follows it."""
    sampler = lattice_sampling.Sampler(lattice_sampling.MODEL, 2)
    words, ends = ["lattice", "segment", "weights"], [",", ".", ";", "!", "?", ".\n", ":\n", "☃", "☃☃"]
    list(sampler.sample([1], [" ".join(w + e for w in words for e in ends)]))
    assert sampler.net.states < 60  # over 200 characters


def test_parts_lose_no_piece():
    """Texts are cut at word borders and where no piece holds both characters; nothing else is lost."""
    import sentencepiece
    processor = sentencepiece.SentencePieceProcessor(model_file=lattice_sampling.MODEL)
    pieces = lattice_sampling.weights(processor)[0]
    pairs = {x for p in pieces for x in itertools.pairwise(p.replace("▁", " "))}
    net = lattice_sampling.Lattices(*lattice_sampling.weights(processor))
    rnd = random.Random(9)
    for _ in range(300):
        texts = ["".join(rnd.choices(" \n\0.,aehtTS9é日本▁🎉☃", k=rnd.randrange(12))) for _ in range(4)]
        parts, count, before = net.cut([t.encode() for t in texts])
        parts, before = iter(parts.to_pylist()), iter(before.tolist())
        for text, n in zip(texts, count.tolist()):
            own = [next(parts).decode() for _ in range(n)]
            full = " " + text if text else ""
            at = [next(before) for _ in range(n)]
            assert "".join(own) == full and at == list(itertools.accumulate(map(len, own), initial=0))[:-1]
            assert all(full[i] == " " != full[i - 1] or (full[i - 1], full[i]) not in pairs for i in at[1:])
            assert set(itertools.accumulate(map(len, lattice_sampling.units(text)), initial=0)) <= {*at, len(full)}


def test_segmentations_decode(odd, empty):
    rows = lattice_sampling.round_trips(odd).collect()
    assert all(r["round_trip"] for r in rows) and len({r["doc_id"] for r in rows}) == 13
    by = Counter((r["doc_id"], tuple(r["ids"])) for r in rows if r["doc_id"] != 12)
    assert set(by.values()) == {1}
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert all(r["decoded"] == texts[r["doc_id"]] for r in lattice_sampling.decode(lattice_sampling.encode(odd)).collect())
    assert lattice_sampling.round_trips(empty).count() == 0


# ---- language model

def brute_scores(rows):
    t = [(i, (x or "").encode().lower().split() + [b" end"], held(i, 5, 1)) for i, x in rows]
    c, big = Counter(), Counter()
    for _, w, out in t:
        if not out:
            c.update(w)
            big.update(zip([b" begin"] + w[:-1], w))
    n, v = sum(c.values()), len(c)
    of = lambda counts: kneser_ney.discounts(*[Counter(counts.values())[i] for i in (1, 2, 3, 4)])
    taken = lambda k, d: max(k - (0, *d)[min(k, 3)], 0)
    ctx, before = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (a, b), k in big.items():
        ctx[a][0] += k
        ctx[a][min(k, 3)] += 1
        before[b] += 1
    d, dw, total = of(big), of(before), sum(before.values())
    m = Counter(min(k, 3) for k in before.values())
    low = lambda w: taken(before[w], dw) / total + sum(x * m[i] for i, x in enumerate(dw, 1)) / total / (v + 1)
    for i, w, out in t:
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        s = sum(math.log10((taken(big[a, b], d) + sum(x * k for x, k in zip(d, ctx[a][1:]))  * low(b)) / ctx[a][0] if ctx[a][0] else low(b)) for a, b in zip([b" begin"] + w[:-1], w))
        yield i, out, len(w), sum(x in c for x in w), n, base, s


@pytest.mark.parametrize("tokens,parts", [(4_000_000, 1 << 21), (300, 64)])
def test_scores_against_brute_force(spark, odd, monkeypatch, tokens, parts):
    monkeypatch.setattr(kneser_ney, "PAIRS", parts)
    monkeypatch.setattr(kneser_ney, "WORDS", parts)
    df = table(spark, SF, "documents").limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [(r[0], r[1]) for r in df.collect()]
    order = lambda x: (-1 if x[0] is None or x[0] != x[0] else x[0], x[2])
    for got, want in zip(sorted((tuple(r) for r in kneser_ney.score(df).collect()), key=order), sorted(brute_scores(rows), key=order), strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5], rel=1e-9) and got[6] == pytest.approx(want[6], rel=1e-9)


def test_probabilities_sum_to_one():
    """Over all known words and one unknown, after any context."""
    n, times = np.array([5, 1, 0, 2, 0]), np.array([3, 1, 2, 1, 0])
    seconds = np.array([2, 1, 1, 0, 1, 7])
    low = kneser_ney.lowest(np.append(times, 0), seconds, 5)
    d = kneser_ney.discounts(4, 2, 1, 1)
    full = lambda x: np.full(6, x)
    p = kneser_ney.smoothed(np.append(n, 0), full(8), full(1), full(1), full(1), low, d)
    assert low.sum() == pytest.approx(1) and p.sum() == pytest.approx(1)


def test_scores_of_an_empty_table(empty):
    assert kneser_ney.score(empty).count() == 0


def test_integer_lists_round_trip():
    x = np.array([0, 1, 1 << 40, 7])
    assert (kneser_ney.unpack_ints(kneser_ney.pack_ints(x, x + 1), 2) == [x, x + 1]).all()
    assert (kneser_ney.unpack(kneser_ney.pack(np.sort(x).astype(np.uint64))) == np.sort(x)).all()
    assert len(kneser_ney.unpack(kneser_ney.pack(np.zeros(0, np.uint64)))) == 0
