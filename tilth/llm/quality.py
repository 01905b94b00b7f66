"""Document quality by a regularised quadratic discriminant.

Each whole text becomes a short vector of transformed statistics. Class means and covariances are
sums over all labelled rows, so they are plain Spark aggregates; the covariances are shrunk towards
the pooled one and towards a multiple of the identity, factored once by Cholesky, and a document's
score is the difference of the two Mahalanobis log densities, mapped to a probability by a logistic
curve fitted to the (binned) differences of all labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.llm.common import bounded_batches, materialize
from tilth.llm.language_id import learning_rows

FEATURES = ("words", "word_length", "long_words", "upper", "digits", "marks", "odd_marks", "space", "lines", "distinct", "repeats", "top_word", "end_marks")

_classes: dict[str, np.ndarray] = {}


def _byte_classes() -> dict[str, np.ndarray]:
    if not _classes:
        kind = np.arange(256)
        upper, lower = (kind >= 65) & (kind <= 90), (kind >= 97) & (kind <= 122)
        digit, space = (kind >= 48) & (kind <= 57), (kind == 32) | ((kind >= 9) & (kind <= 13))
        mark = (kind < 128) & ~(upper | lower | digit | space)
        plain = np.isin(kind, list(b".,;:'\"-()?"))
        _classes.update(upper=upper, letter=upper | lower | (kind >= 194), digit=digit, space=space, mark=mark, odd=mark & ~plain, line=kind == 10)
    return _classes


def statistics(text: str | None) -> list[float]:
    """The vector of one whole text; a null or empty text has the one of no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = {k: int(counts[v].sum()) for k, v in _byte_classes().items()}
    words = raw.split()
    n, size, solid = len(words), max(1, len(raw)), max(1, len(raw) - of["space"])
    lengths = list(map(len, words))
    bag: dict[bytes, int] = {}
    for w in words:
        bag[w] = bag.get(w, 0) + 1
    some = max(1, n)
    ends = sum(1 for w in words if w[-1] < 48 and w[-1] not in b".,)'\"")
    share = lambda x, y: math.sqrt(x / y)
    return [
        math.log1p(n),
        math.log1p(sum(lengths) / some),
        share(sum(1 for x in lengths if x > 20), some),
        share(of["upper"], max(1, of["letter"])),
        share(of["digit"], solid),
        share(of["mark"], solid),
        share(of["odd"], solid),
        share(of["space"], size),
        math.log1p(of["line"] / some * 100),
        math.log(max(1, len(bag))) / math.log(some) if n > 1 else 1.0,
        share(sum(map(eq, words, words[1:])), some),
        share(max(bag.values(), default=0), some) if n > 4 else 0.3,
        share(ends, some),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id and one double per statistic, a row per row."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            table = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, table.T.copy())], ["doc_id", *FEATURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of classes 0 and 1, and the logistic curve."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    slope: float
    intercept: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density under class 1 less that under class 0."""
        if not len(self.means):
            return np.zeros(len(x))
        logs = [-0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) - 0.5 * self.log_dets[c] for c in (0, 1)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(self.difference(x)) + self.intercept, -700, 700)))


def squash(difference: np.ndarray) -> np.ndarray:
    """Keeps the order of differences, log-scaled beyond a few nats."""
    return np.sign(difference) * np.log1p(np.abs(difference))


def train(statistics_: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = 0.02, pool: float = 0.05) -> Discriminant:
    """Fit to rows of ``statistics_`` that aren't held out and have a 0/1 ``label`` in ``labels`` (doc_id, label, ...).

    Rows of a doc_id with several labels count with the smallest; null labels and doc_ids teach
    nothing. With fewer than two rows of a class every score is the share of label 1 (0.5 without
    labels). The driver receives moments and a histogram, whose size depends on neither table.
    """
    wanted = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"))
    rows = materialize(learning_rows(statistics_).join(wanted, "doc_id"), "labelled")
    d = len(FEATURES)
    moments = rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)],
    )
    by = {int(r["y"]): r for r in moments.collect()}  # two rows
    n = [by[c]["n"] if c in by else 0 for c in (0, 1)]
    if min(n) < 2:
        share = (n[1] + 1e-9) / (sum(n) + 2e-9)
        return Discriminant(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    means, scatter = [], []
    for c in (0, 1):
        s = np.array([by[c][f"s{i}"] for i in range(d)]) / n[c]
        p = np.array([[by[c][f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / n[c]
        means.append(s)
        scatter.append(p - np.outer(s, s))
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / sum(n)
    unit = np.diag(np.maximum(np.diag(pooled), 1e-8))
    factors, log_dets = [], []
    for c in (0, 1):
        cov = (1 - shrink - pool) * scatter[c] + pool * pooled + shrink * unit
        low = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * np.log(np.diag(low)).sum())
    model = Discriminant(np.array(means), np.array(factors), np.array(log_dets), 1.0, 0.0)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def differences(frames):
        for frame in frames:
            x = squash(shared.value.difference(frame[list(FEATURES)].to_numpy()))
            yield pd.DataFrame({"bin": np.round(np.clip(x, -12, 12) * 20).astype("int32"), "y": frame["y"].astype("int32")})

    seen = rows.mapInPandas(differences, "bin int, y int").groupBy("bin", "y").count().toPandas()  # at most 962 rows
    model.slope, model.intercept = logistic(seen["bin"].to_numpy() / 20, seen["y"].to_numpy(float), seen["count"].to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not negative) and intercept of a weighted logistic fit, by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        v = weight * p * (1 - p) + 1e-9
        g = np.array([(weight * (y - p) * x).sum() - ridge * (a - 1), (weight * (y - p)).sum() - ridge * b])
        h = np.array([[(v * x * x).sum() + ridge, (v * x).sum()], [(v * x).sum(), v.sum() + ridge]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(1e-3, a + step[0]), b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def score(statistics_: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``statistics_``, repeated and null doc_ids too."""
    shared = statistics_.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": shared.value.score(frame[list(FEATURES)].to_numpy())})

    return statistics_.mapInPandas(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Discriminant, least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose score is at least ``least``, all columns as they were."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(shared.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
