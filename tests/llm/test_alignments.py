"""Template decontamination: every alignment, and every window."""

import pytest

from tracehold.llm import template_decontam

STEM = "please read the following question with care and then answer"
SHEET = STEM + " " + " ".join(f"word{i}" for i in range(30))
VARIANT = "a box with {0} red and {1} blue marbles loses {0} red and {1} blue ones every day until none are left"
TRAIN = "A train travels 60 km in 2 hours then 90 km in 3 hours how far does it go"
SLOTS = "mix 1 2 3 4 5 6 7 8 9"
SERIES = "What comes next: 2 4 8 16 32"


def found(spark, item, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = template_decontam.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert len(got) <= 1
    return got[0]["kind"] if got else None


@pytest.mark.parametrize("item,text,kind", [
    (SHEET, f"{STEM} {'x ' * 20}{STEM} {'y ' * 20}{SHEET}", "copy"),  # stray hits of a common stem before a copy
    (VARIANT.format(5, 9), VARIANT.format(11, 12) + " " + VARIANT.format(13, 14), "reparameterised"),  # two variants in a row
    (SHEET, SHEET.replace("word9", "word9 and so on"), "copy"),  # an insertion moves the rest
])
def test_every_alignment_is_judged(spark, item, text, kind):
    assert found(spark, item, text) == kind


@pytest.mark.parametrize("item,text,kind", [
    (SLOTS, "Some words come before all of it. " + SLOTS + " And some after it, too.", "copy"),
    (TRAIN, TRAIN.replace("60", "70").replace("90", "80"), "reparameterised"),
    (TRAIN, "A train travels 60 km in 2 days and 45 90 km in 3 hours how far does it go", None),
    (SERIES, "We ask what comes next: 5 7 and then, of course, other things.", None),
    (SERIES, "Well, what comes next: 5 7 9 11 13", "reparameterised"),
    ("3 5 7 11 13 17", "totals 90 81 72 63 54 45 by year", None),
    ("3 5 7 11 13 17", "primes 3 5 7 11 13 17 by size", "copy"),
])
def test_every_window_counts(spark, item, text, kind):
    assert found(spark, item, text) == kind


def plain_windows(text):
    """Token by token: each window's reading, place, length and content."""
    td, raw = template_decontam, (text or "").split()
    words = [td._EDGE.sub("", w) for w in raw]
    number = [bool(td._NUMBER.match(w)) for w in words]
    slot = [1 if number[i] else 2 if w.lower() in td.UNITS and i and number[i - 1] else 3 if w[:1].isupper() and not w.isupper() and not (number[i] or w.lower() in td.UNITS and i and number[i - 1]) and i and raw[i - 1][-1] not in ".!?:" else 0
            for i, w in enumerate(words)]
    size = min(5, len(raw))
    return [(names, p, size, tuple(slot[q] * (slot[q] < 3 or names) or words[q].lower() for q in range(p, p + size))) for names in (True, False) for p in range(len(raw) - size + 1) if raw]


def test_texts_read_together(monkeypatch):
    """Windows of odd tokens, short, empty and null texts, read at once and one by one, with and without forgetting."""
    texts = ["", None, "one", "3 kg", "Ab Cd ef. Gh 5 kg", "\uff15 km x\u00b2 \u01c5a \u0391\u0392 \U0001d400b \U0001d400\u0132b", " ", "$5.00 -3% _ __ it's (Foo) \u00abBar\u00bb Km km 7 h h", "end. Start: Now, Then! 12:30 KG Mm", "... -- \u2014", "5", "kg Ab Cd ef gh", "A Bc", ""]
    content, reader = {}, template_decontam.Templates()
    for at_once in (texts, *[[t] for t in texts]):
        got, want = [], [(k, *w) for k, t in enumerate(at_once) for w in plain_windows(t)]
        for names, words, slot, of, at, sizes, h in reader.windows(at_once):
            start = [sum(map(len, words[:k])) for k in range(len(words))]
            got += [(k, names, p - start[k], s, x) for k, p, s, x in zip(of.tolist(), at.tolist(), sizes.tolist(), h.tolist())]
        assert sorted(g[:4] for g in got) == sorted(w[:4] for w in want)
        by = {w[:4]: w[4] for w in want}
        for g in got:
            assert content.setdefault(g[4], (g[1], by[g[:4]])) == (g[1], by[g[:4]])
    assert len(set(content.values())) == len(content)
    monkeypatch.setattr(template_decontam, "READ", 30)
    import pyarrow as pa
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])
    pieces = list(template_decontam._together(iter([batch])))
    assert len(pieces) > 3 and [t for _, ts in pieces for t in ts] == texts and [k for ks, _ in pieces for k in ks] == list(range(len(texts)))
