"""Toxicity as cumulative-link ordinal regression over sparse text features.

P(grade > j) = sigmoid(w.x - t_j) with one weight vector for all ordered thresholds t_0 < t_1 < ...;
the score is the expected grade, the sum of those probabilities.

Features are words and their first four and five letters. They are counted over the labelled rows in
Spark, and the ``FEATURES`` with the strongest association are kept; only their counts reach the driver,
for ``FIT_ROWS`` labelled rows at most, so the fit is bounded while scoring covers every row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.common import columns, cut, slices

#: Labelled rows that a fit reads (those with the least hash of their id), and features it keeps.
FIT_ROWS, FEATURES, EVIDENCE = 20_000, 4096, 20.0
#: A row is rejected from this probability on of a grade above zero.
REJECT = 0.5
_WORD = re.compile(r"\w+")


def features(text: str | None) -> Counter:
    out = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        out[word] += n
        for k in (4, 5):
            if len(word) > k:
                out[word[:k] + "*"] += n
    return out


@dataclass
class Ordinal:
    """weights by feature, and the thresholds in order."""
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [0.0])

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > j) for every threshold j."""
        get = self.weights.get
        s, seen = 0.0, Counter(_WORD.findall((text or "").lower()))
        prefixes: Counter = Counter()
        for word, n in seen.items():
            if w := get(word):
                s += w * np.log1p(n)
            if len(word) > 4:
                prefixes[word[:4] + "*"] += n
                if len(word) > 5:
                    prefixes[word[:5] + "*"] += n
        for p in prefixes.keys() & self.weights.keys():
            s += get(p) * np.log1p(prefixes[p])
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - s, -60, 60)))


def fit_ordinal(x: list[dict[int, float]], grades: np.ndarray, width: int, l2: float = 1e-3, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean negative log-likelihood. Rows are sparse."""
    k = int(grades.max())
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.fromiter((c for r in x for c in r), np.int64, len(rows))
    vals = np.fromiter((v for r in x for v in r.values()), float, len(rows))
    share = np.array([(grades > j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log(1 / share - 1) + 1e-3 * np.arange(k))
    # thresholds as the first and the logs of the steps between them, so that they stay in order
    p = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = np.arange(len(grades))
    for step in range(1, steps + 1):
        w, t = p[:width], np.concatenate([p[width:width + 1], p[width] + np.cumsum(np.exp(p[width + 1:]))])
        s = np.bincount(rows, vals * w[cols], len(x))
        up = 1 / (1 + np.exp(np.clip(t[None] - s[:, None], -60, 60)))  # P(grade > j)
        edge = np.concatenate([np.ones((len(x), 1)), up, np.zeros((len(x), 1))], axis=1)
        slope = edge * (1 - edge)
        mass = np.maximum(edge[n, grades] - edge[n, grades + 1], 1e-12)
        ds = -(slope[n, grades] - slope[n, grades + 1]) / mass / len(x)
        dt = np.zeros((len(x), k + 2))
        dt[n, grades] += slope[n, grades] / mass
        dt[n, grades + 1] -= slope[n, grades + 1] / mass
        dt = dt[:, 1:k + 1].sum(axis=0) / len(x)
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, vals * ds[rows], width) + l2 * w / 10, tail[:1], tail[1:] * np.exp(p[width + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:width], np.concatenate([p[width:width + 1], p[width] + np.cumsum(np.exp(p[width + 1:]))])


_FOUND = [("row", pa.int64()), ("key", pa.int64()), ("same", pa.int64()), ("toxic", pa.int32()), ("feature", pa.string()), ("n", pa.int64())]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a feature; a text without features has one row, whose feature is null."""
    for b in slices(batches):
        for row, key, same, text, toxic in zip(*(b.column(c).to_pylist() for c in ("row", "key", "same", "text", "toxic"))):
            f = features(text) or {None: 0}
            of = len(f)
            values = [[row] * of, [key] * of, [same] * of, [toxic] * of, list(f), list(f.values())]
            yield pa.record_batch([pa.array(v, t) for v, (_, t) in zip(values, _FOUND)], [n for n, _ in _FOUND])


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text and label of at most ``limit`` labelled rows, those with the least hash of their id.
    Rows without an id or a label, and ids that are not in ``docs``, give none."""
    known = columns(labels, doc_id="doc_id", label=label).filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # its size is bounded by limit
    return columns(docs, doc_id="doc_id", text="text").join(F.broadcast(some), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, keep: int = FEATURES) -> Ordinal:
    """Grades from ``label``: where it has two values only, the rows of the higher one are graded 1 to 3
    by thirds of how many occurrences of features that mark it they hold. Without both values among the
    labels every row has grade zero. Rows that share an id are rows of their own, also where their texts
    are equal; of more than ``rows`` those with the least hashes of id and text count. A null or empty text
    is a row without features."""
    sample = (labelled(docs, labels, label, rows).select(F.col("doc_id").alias("key"), "text", F.col("label").cast("int").alias("toxic"))
              .withColumns({"same": F.xxhash64("text"), "row": F.monotonically_increasing_id()}))
    found = cut(sample.mapInArrow(_feature_rows, "row long, key long, same long, toxic int, feature string, n long"), "toxicity-features")
    per_row = found.groupBy("row").agg(*[F.max(c).alias(c) for c in ("key", "same", "toxic")])
    totals = lambda df: df.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") > 0).alias("p"), F.max("toxic").alias("top")).first()
    total = totals(per_row)
    if total["n"] > rows:
        per_row = cut(per_row.orderBy(F.xxhash64("key"), "key", "same", "row").limit(rows), "toxicity-rows")
        found, total = found.join(per_row.select("row"), "row", "left_semi"), totals(per_row)
    n, p = total["n"], total["p"]
    if not p or p == n:
        return Ordinal(thresholds=[30.0])
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    cell = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    b, d = p - a, (n - p) - c
    seen = a + c
    g2 = 2 * (cell(a, seen * p / n) + cell(c, seen * (n - p) / n) + cell(b, (n - seen) * p / n) + cell(d, (n - seen) * (n - p) / n))
    kept = (found.filter("feature IS NOT NULL").groupBy("feature").agg(F.count_if(F.col("toxic") > 0).alias("a"), F.count_if(F.col("toxic") <= 0).alias("c"))
            .filter("a + c >= 3").select("feature", g2.alias("g2"), (a / p > c / (n - p)).alias("marks"))
            .filter(F.col("g2") >= EVIDENCE).orderBy(F.desc("g2"), "feature").limit(keep))  # bounded by keep
    kept = cut(kept, "toxicity-kept")
    names = {r["feature"]: (i, r["marks"]) for i, r in enumerate(kept.orderBy("feature").collect())}
    pairs = found.join(F.broadcast(kept), "feature").groupBy("row").agg(F.map_from_arrays(F.collect_list("feature"), F.collect_list("n")).alias("has"))
    rows_ = per_row.join(pairs, "row", "left").orderBy("key", "same", "row").collect()
    x = [{names[f][0]: float(np.log1p(k)) for f, k in sorted((r["has"] or {}).items())} for r in rows_]
    grades = np.array([max(0, r["toxic"]) for r in rows_])
    if total["top"] == 1:
        hits = np.array([sum(k for f, k in (r["has"] or {}).items() if names[f][1] and not f.endswith("*")) for r in rows_])
        low, high = np.quantile(hits[grades > 0], [1 / 3, 2 / 3])
        grades = np.where(grades > 0, 1 + (hits > low) + (hits > high), 0)
        grades = np.unique(grades, return_inverse=True)[1]
    w, t = fit_ordinal(x, grades, len(names))
    return Ordinal({f: float(w[i]) for f, (i, _) in names.items()}, t.tolist())


def _scores(model: Ordinal, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        above = [model.above(t) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), pa.array([float(a[0]) for a in above]), pa.array([float(a.sum()) for a in above]),
                               pa.array([int((a >= 0.5).sum()) for a in above], pa.int32())], ["doc_id", "p_toxic", "severity", "grade"])


def score(docs: DataFrame, model: Ordinal, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_toxic (probability of a grade above zero), severity (expected grade) and grade (the
    median grade) for every row and whole text. Null and empty texts score as a text without features;
    repeated rows and null ids score like any other; an empty table gives no rows."""
    return columns(docs, doc_id=doc_id, text=text).mapInArrow(partial(_scores, model), "doc_id long, p_toxic double, severity double, grade int")


def _mild(model: Ordinal, reject: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield b.filter(pa.array([bool(model.above(t)[0] < reject) for t in b.column("text").to_pylist()], pa.bool_()))


def without_toxic(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """The rows, all columns, whose probability of a grade above zero is under ``reject``."""
    return docs.mapInArrow(partial(_mild, model, reject), docs.schema)
