"""Stages of the pipeline: each row by its own key, and near copies at a similarity of 0.8."""

import random

import pytest

import corpus_pipeline
from tracehold.llm import common, lattice_sampling, shingle_links, simhash_bktree, template_decontam

SCHEMA = "doc_id long, text string"
PLAIN = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]


@pytest.mark.parametrize("written", [False, True])
def test_each_row_has_its_own_fate(spark, tmp_path, written):
    """Null ids and a repeated id, in memory and read from files."""
    rows = [(None, PLAIN[0]), (None, PLAIN[0]), (None, PLAIN[1]), (5, PLAIN[2]), (5, PLAIN[2]), (5, PLAIN[3]), (4, PLAIN[3] + " ")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if written:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    want = sorted([(None, PLAIN[0]), (None, PLAIN[1]), (5, PLAIN[2]), (4, PLAIN[3] + " ")], key=str)
    for stage in (corpus_pipeline.exact_duplicates, corpus_pipeline.near_duplicates):
        assert sorted((tuple(r) for r in stage(spark, docs, "").collect()), key=str) == want
    items = spark.createDataFrame([(1, PLAIN[0]), (2, " ".join(PLAIN[1].split()[20:] + PLAIN[2].split()[:20]))], "item_id long, text string")
    left = template_decontam.without_contaminated(docs, items).collect()
    assert sorted((tuple(r) for r in left), key=str) == sorted(rows[2:], key=str)


def test_near_copies_at_a_similarity_of_four_fifths(spark):
    rnd = random.Random(6)
    rows, want = [], 0
    for i in range(60):
        words = [f"w{rnd.randrange(9999)}" for _ in range(rnd.randrange(150, 600))]
        rows.append((2 * i, " ".join(words)))
        for at in rnd.sample(range(len(words)), len(words) // 50):
            words[at] = f"new{rnd.randrange(9999)}"
        rows.append((2 * i + 1, " ".join(words)))
        alike = shingle_links.jaccard(*[shingle_links.shingles(t) for _, t in rows[-2:]])
        want += alike >= 0.8
    assert want > 20
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert {2 * i for i in range(60)} <= left and len(left) == 120 - want


def plain_groups(texts, similar=0.8):
    """The least place that links of at least ``similar`` reach, for each text."""
    sets, up = [set(shingle_links.shingles(t).tolist()) for t in texts], list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= similar:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [top(i) for i in range(len(texts))]


def changed(rnd, words, n):
    """The words with n of them replaced, most often by new ones, now and then by the same ones as in other texts."""
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.randrange(10 ** 6)}" if rnd.random() < 0.9 else f"same{at}"
    return words


@pytest.mark.parametrize("block", [256, 7])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block):
    """A crowd of copies of one text with few and many changes, chains of copies of copies, texts that share
    one long passage and are not alike, null, empty and repeated texts."""
    monkeypatch.setattr(shingle_links, "BLOCK", block)
    rnd = random.Random(3)
    base, passage = [f"b{i}" for i in range(150)], " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(changed(rnd, base, rnd.choice([0, 1, 2, 3, 4, 5, 8]))) for _ in range(300)]
    link = [f"c{i}" for i in range(120)]
    for _ in range(40):
        texts.append(" ".join(link))
        link = changed(rnd, link, 2)
    texts += [passage + " " + " ".join(f"o{rnd.randrange(10 ** 6)}" for _ in range(rnd.choice([8, 12, 16, 30]))) for _ in range(80)]
    texts += [None, "", " \n", "one two", "one two", "one  two ", "three", texts[5], texts[5]]
    want = plain_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(5)
    label = {r["row"]: r["label"] for r in shingle_links.near_duplicates(docs, "doc_id").collect()}
    assert len(label) == len(texts) and len(set(want[:300])) > 1
    got, found = {}, []
    for i in range(len(texts)):
        found.append(got.setdefault(label[i], i))
    split = [i for i in range(len(texts)) if found[i] != want[i]]
    assert all(want[i] == want[found[i]] for i in range(len(texts)))  # nothing is linked that is not alike
    assert len(split) <= 0.01 * len(texts)  # bands miss a pair just above the threshold in five hundred


def test_shingles_of_odd_rows(spark, odd, empty):
    from tracehold.llm.common import ROW, keyed
    rows = keyed(odd)
    label = {r[ROW]: r["label"] for r in shingle_links.near_duplicates(rows, ROW).withColumnRenamed("row", ROW).collect()}
    of = [(r["doc_id"], label[r[ROW]]) for r in rows.collect()]
    ids = lambda *want: {x for i, x in of if i in want}
    assert len(of) == 14 and len(ids(1, 2, 3, None)) == len(ids(4, 5, 6)) == len(ids(7, 8)) == len(ids(12)) == 1 and len({x for _, x in of}) == 7
    assert shingle_links.near_duplicates(keyed(empty), ROW).count() == 0


def test_class_links_connect_what_the_radius_connects():
    rnd = random.Random(2)
    for _ in range(40):
        values = [rnd.getrandbits(128) for _ in range(4)]
        for _ in range(rnd.randrange(60)):
            v = rnd.choice(values)
            for _ in range(rnd.randrange(40)):
                v ^= 1 << rnd.randrange(128)
            values.append(v)
        values = list(dict.fromkeys(values))
        values = [values[i] for i in simhash_bktree.middle_first(values)]
        links, near = list(simhash_bktree.class_links(values, 32)), lambda i, j: (values[i] ^ values[j]).bit_count() <= 32
        assert all(near(i, j) for i, j in links)
        of = [list(range(len(values))) for _ in range(2)]
        for label, pairs in zip(of, (links, [(i, j) for i in range(len(values)) for j in range(i) if near(i, j)])):
            for i, j in pairs:
                x, y = sorted((label[i], label[j]))
                label[:] = [x if a == y else a for a in label]
        assert of[0] == of[1]


def test_labels_count_as_connected():
    """Values of one label need no link; what is left connects what the radius and the labels connect."""
    rnd = random.Random(5)
    assert not list(simhash_bktree.class_links([1, 2, 3, 7], 32, [4, 4, 4, 4]))
    for _ in range(20):
        values = list(dict.fromkeys(rnd.choice([0, (1 << 128) - 1]) ^ sum(1 << rnd.randrange(128) for _ in range(rnd.randrange(30))) & (1 << 128) - 1 for _ in range(40)))
        labels = [rnd.randrange(60) for _ in values]
        links = list(simhash_bktree.class_links(values, 16, labels))
        near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 16]
        assert set(links) <= set(near) and all(labels[i] != labels[j] for i, j in links)
        of = [list(labels) for _ in range(2)]
        for label, pairs in zip(of, (links, near)):
            for i, j in pairs:
                x, y = sorted((label[i], label[j]))
                label[:] = [x if a == y else a for a in label]
        assert of[0] == of[1]


def test_a_crowd_of_near_copies_has_few_links(spark, monkeypatch):
    """Every member has 83 keys; it is not linked anew by each, and an edge is held once."""
    rnd, seen = random.Random(8), {"simhash-edges": [], "shingle-near": []}
    base = [f"b{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(changed(rnd, base, 2))) for i in range(400)], SCHEMA)

    def counted(df, name="cut"):
        out = common.cut(df, name)
        if name in seen:
            seen[name].append(out.count())
        return out

    monkeypatch.setattr(simhash_bktree, "cut", counted)
    monkeypatch.setattr(shingle_links, "cut", counted)
    labels = shingle_links.near_duplicates(docs, "doc_id")
    assert labels.select("label").distinct().count() == 1
    assert sum(seen["shingle-near"]) <= 20 * 400 and max(seen["simhash-edges"]) <= sum(seen["shingle-near"])


def test_near_copies_come_from_simhash_buckets(spark, monkeypatch):
    """Without the links of the BK-trees nothing is found."""
    docs = spark.createDataFrame([(1, PLAIN[0] + " " + PLAIN[1]), (2, PLAIN[0] + " " + PLAIN[1] + " end")], SCHEMA)
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 1
    monkeypatch.setattr(simhash_bktree, "bucket_links", lambda keyed, radius: spark.createDataFrame([], "a long, b long"))
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 2


def test_a_worker_drops_what_another_operator_kept():
    common.kept("lattices", lambda: 1)
    assert list(common.slices(iter([]), name="lattices")) == [] and common.kept("lattices", lambda: 2) == 1
    assert list(common.slices(iter([]))) == [] and common.kept("lattices", lambda: 2) == 2


def test_units_of_plain_and_odd_spacing():
    for text in ("a b", " a b", "a  b", "a b ", "a\0b c", "a\nb c", "a", " ", "▁ é"):
        assert lattice_sampling.units(text) == lattice_sampling._UNIT.findall(" " + text)
    assert lattice_sampling.units("") == lattice_sampling.units(None) == []
