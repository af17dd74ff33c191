"""Document quality by histogram gradient-boosted trees over statistics of the text.

The statistics are counted for every whole text by its Spark task. The trees are fitted on the driver on
the statistics (not the texts) of ``FIT_ROWS`` labelled rows at most, and flattened into arrays: a tree
of depth D is 2^D - 1 features and thresholds and 2^D leaf values in heap order, so a batch walks all
trees at once with numpy indexing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import as_bytes, columns, crc_mod, slices
from tracehold.llm.ordinal_toxicity import labelled

FIT_ROWS, BINS, TREES, DEPTH, RATE = 20_000, 64, 80, 4, 0.15
HELD_OUT, GOOD = 5, 0.3
_MARKS = re.compile(rb"[^\w\s\x80-\xff]{2,}")
STATISTICS = ("bytes", "words", "lines", "upper", "lower", "digit", "space", "mark", "wide", "control", "byte_entropy", "word_length", "long_word", "distinct_words",
              "top_word", "same_next", "distinct_pairs", "marked_words", "mark_runs", "capital_words", "distinct_lines", "top_line", "line_length", "ended_lines",
              "word_entropy", "bars", "digit_words", "one_letter")


def _share(n, of) -> float:
    return float(n) / of if of else 0.0


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def statistics(text: str | None) -> list[float]:
    """One value for each of ``STATISTICS``; zeros for a null or empty text."""
    raw = as_bytes(text)
    if not raw:
        return [0.0] * len(STATISTICS)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words = len(raw), raw.split()
    k = len(words)
    seen = Counter(words)
    counts = np.fromiter(seen.values(), np.int64, len(seen))
    lines = [x for x in raw.split(b"\n") if x]
    same = Counter(lines)
    lengths = np.fromiter(map(len, words), np.int64, k)
    letters, upper, lower, digit = by[65:91].sum() + by[97:123].sum(), by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    space = by[32] + by[9:14].sum()
    wide, control = by[128:].sum(), by[:9].sum() + by[14:32].sum() + by[127]
    runs = _MARKS.findall(raw)
    return [np.log1p(n), np.log1p(k), np.log1p(len(lines)), _share(upper, letters), _share(lower, n), _share(digit, n), _share(space, n),
            _share(n - letters - digit - space - wide - control, n), _share(wide, n), _share(control, n), _entropy(by),
            float(lengths.mean()) if k else 0.0, np.log1p(lengths.max()) if k else 0.0, _share(len(seen), k), _share(counts.max() if k else 0, k),
            _share(sum(map(bytes.__eq__, words, words[1:])), k), _share(len(set(zip(words, words[1:]))), max(1, k - 1)),
            _share(sum(1 for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128 for _ in range(c)), k), _share(len(runs), k),
            _share(sum(c for w, c in seen.items() if w.isupper() and len(w) > 1), k), _share(len(same), len(lines)), _share(max(same.values(), default=0), len(lines)),
            np.log1p(n / max(1, len(lines))), _share(sum(1 for x in lines if x[-1:] in b".!?:;"), len(lines)), _entropy(counts), _share(by[124], k),
            _share(sum(c for w, c in seen.items() if w.isdigit()), k), _share(int((lengths == 1).sum()), k)]


@dataclass
class Trees:
    """features and thresholds (trees, 2^depth - 1), values (trees, 2^depth), and the log-odds before them."""
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        inner = self.features.shape[1]
        at = np.zeros((len(x), len(self.features)), np.int64)
        tree, row = np.arange(len(self.features))[None], np.arange(len(x))[:, None]
        while at.size and at[0, 0] < inner:
            at = 2 * at + 1 + (x[row, self.features[tree, at]] > self.thresholds[tree, at])
        margin = self.start + (self.values[tree, at - inner].sum(axis=1) if at.size else 0.0)
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: float = 1.0) -> Trees:
    """Logistic loss, second-order gains over histograms of quantile bins, whole levels at a time."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, inner = np.full(n, start), (1 << depth) - 1
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), start)
    base = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            place = ((node - first)[:, None] * width * bins + base + binned).ravel()
            sums = [np.bincount(place, np.repeat(v, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (ga, ha) = sums, [s[:, :1, -1:] for s in sums]
            gain = gl ** 2 / (hl + least) + (ga - gl) ** 2 / (ha - hl + least) - ga ** 2 / (ha + least)
            gain[(hl < least) | (ha - hl < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            feature, cut_at = best // bins, best % bins
            for i in range(many):
                if gain[i, feature[i], cut_at[i]] > 1e-9 and cut_at[i] < len(edges[feature[i]]):
                    out.features[t, first + i], out.thresholds[t, first + i] = feature[i], edges[feature[i]][cut_at[i]]
            node = 2 * node + 1 + (x[np.arange(n), out.features[t, node]] > out.thresholds[t, node])
        leaf = node - inner
        out.values[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + least)
        margin = margin + out.values[t, leaf]
    return out


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.record_batch([b.column("doc_id"), b.column("label"), pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Trees:
    """Trees for P(label = 1), from at most ``rows`` of the given labels. Without labels of both kinds
    every score is the share of ones among them (one half without any)."""
    got = (labelled(docs, labels, label, rows).select("doc_id", "text", F.col("label").cast("int").alias("label"))
           .mapInArrow(_statistics_rows, "doc_id long, label int, x array<double>").orderBy("doc_id").toPandas())
    y = (got["label"].to_numpy() > 0).astype(float)
    if len(np.unique(y)) < 2:
        mean = y.mean() if len(y) else 0.5
        return Trees(np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)), float(np.log((mean + 1e-6) / (1 - mean + 1e-6))))
    return fit_trees(np.stack(got["x"].to_numpy()), y)


def _scores(model: Trees, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = np.array([statistics(t) for t in b.column("text").to_pylist()], float).reshape(-1, len(STATISTICS))
        yield pa.record_batch([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])


def score(docs: DataFrame, model: Trees, good: float = GOOD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row and whole text; null and empty texts are
    scored as texts whose statistics are all zero. Repeated rows and null ids (whose checksum is that of
    the empty text) score like any other; an empty table gives no rows."""
    return (columns(docs, doc_id="doc_id", text="text").mapInArrow(partial(_scores, model), "doc_id long, score double")
            .select("doc_id", (crc_mod(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "score", (F.col("score") >= good).cast("int").alias("predicted")))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(crc_mod(F.col("doc_id"), HELD_OUT) != 0)
