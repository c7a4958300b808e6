"""Toxicity categories by a classifier chain.

Categories are predicted one after another; a later linear model also sees the probabilities of the earlier ones. For
training these come from models that have not seen the row (out of fold), so they are as uncertain as in use.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed word features, and the bounds of the fitted sample: rows, and characters of a row.
DIMENSIONS = 1 << 18
TRAINING_ROWS = 8_000
TRAINING_CHARS = 20_000
FOLDS = 4
STEPS = 60
#: A word counts when its log ratio is so many standard errors from zero.
LEAST_ERRORS = 3
CACHE_ENTRIES = 1_000_000
_WORD = re.compile(r"\w+")


class _Places(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMENSIONS
        return value


_places = _Places()


def word_places(text: str | None) -> np.ndarray:
    """Places of the distinct lower-cased words of a text."""
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter(map(_places.__getitem__, words), dtype=np.int32, count=len(words)))


@dataclass
class Linear:
    """Logistic model: a weight per place, per earlier category, and a constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def probability(self, flat: np.ndarray, starts: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[flat], dtype=np.float64)))
        return 1 / (1 + np.exp(-np.clip(sums[starts[1:]] - sums[starts[:-1]] + earlier @ self.earlier + self.constant, -30, 30)))


def fit_linear(flat: np.ndarray, starts: np.ndarray, earlier: np.ndarray, target: np.ndarray) -> Linear:
    """Logistic regression on word presence, each scaled by its log count ratio between the classes where that
    is significant; Adam steps."""
    rows = np.repeat(np.arange(len(target)), np.diff(starts))
    in_bad = np.bincount(flat, weights=target[rows], minlength=DIMENSIONS)
    in_all = np.bincount(flat, minlength=DIMENSIONS)
    bad, good = target.sum() + 1, (1 - target).sum() + 1
    ratio = np.log(((in_bad + 0.5) / bad) / ((in_all - in_bad + 0.5) / good))
    error = np.sqrt(1 / (in_bad + 0.5) + 1 / (in_all - in_bad + 0.5))
    ratio[np.abs(ratio) < LEAST_ERRORS * error] = 0
    scaled = ratio[flat]
    weight = np.where(target > 0, 0.5 / bad, 0.5 / good)
    theta = np.concatenate((np.zeros(DIMENSIONS), np.zeros(earlier.shape[1] + 1)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    side = np.column_stack((earlier, np.ones(len(target))))
    for step in range(1, STEPS + 1):
        score = np.bincount(rows, weights=scaled * theta[flat], minlength=len(target)) + side @ theta[DIMENSIONS:]
        error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target)
        slope = np.concatenate((np.bincount(flat, weights=scaled * error[rows], minlength=DIMENSIONS), side.T @ error)) + 1e-5 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Linear((ratio * theta[:DIMENSIONS]).astype(np.float32), theta[DIMENSIONS:-1], float(theta[-1]))


@dataclass
class Chain:
    models: list[Linear]
    limit: float

    def probabilities(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        known = np.zeros((len(starts) - 1, 0))
        for model in self.models:
            known = np.column_stack((known, model.probability(flat, starts, known)))
        return known


def _rows(flat: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(starts)
    return flat[np.repeat(keep, sizes)], np.concatenate(([0], np.cumsum(sizes[keep])))


def fit_chain(places: list[np.ndarray], targets: np.ndarray, folds: np.ndarray) -> Chain:
    """One model per column of ``targets``; the limit on the last one has the best F1 out of
    fold, midway to the next row below."""
    flat = np.concatenate([np.empty(0, np.int32), *places])
    starts = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int64)
    earlier, models = np.zeros((len(places), 0)), []
    for column in range(targets.shape[1]):
        target, out = targets[:, column].astype(float), np.zeros(len(places))
        for fold in range(FOLDS):
            held = folds == fold
            if held.any() and (~held).any():
                model = fit_linear(*_rows(flat, starts, ~held), earlier[~held], target[~held])
                out[held] = model.probability(*_rows(flat, starts, held), earlier[held])
        models.append(fit_linear(flat, starts, earlier, target))
        earlier = np.column_stack((earlier, out))
    order = np.argsort(-earlier[:, -1], kind="stable")
    hits = np.cumsum(targets[order, -1])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, targets[:, -1].sum()))
    if not hits.size or not hits[-1]:
        return Chain(models, 1.1)
    ranked = np.append(earlier[order, -1], 0.0)
    best = int(f1.argmax())
    return Chain(models, float(ranked[best] + ranked[best + 1]) / 2)


def predict(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], text: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., toxic): probabilities in the order of ``categories``; the last one decides.

    ``categories`` are conditions on the columns of ``labels``; null conditions drop the label row. The sample is the
    TRAINING_ROWS labelled rows of smallest hash with at most TRAINING_CHARS characters. All rows are scored, over
    their whole texts; null and empty texts have no words. Without labels, or without a toxic one, nothing is toxic.
    Repeated rows are scored each; a null doc_id is scored and never learnt from.
    """
    names = list(categories)
    marked = labels.select("doc_id", *[c.cast("int").alias(n) for n, c in categories.items()]).dropna()
    marked = marked.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    count = max(1, marked.count())
    share = min(1.0, 2 * TRAINING_ROWS / count)
    marked = marked.withColumn("h", F.xxhash64(F.lit(5), "doc_id")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = docs.where(F.length(text) <= TRAINING_CHARS).select("doc_id", F.col(text).alias("text")).join(marked, "doc_id")
    sample = drawn.orderBy("h", "text").limit(TRAINING_ROWS).select("doc_id", "text", *names).toPandas()
    chain = None
    if len(sample):
        folds = np.array([zlib.crc32(str(d).encode()) % FOLDS for d in sample["doc_id"]])
        chain = fit_chain([word_places(t) for t in sample["text"]], sample[names].to_numpy(dtype=np.int64), folds)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # one weight per place

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            places = [word_places(t) for t in batch["text"].tolist()]
            starts = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int64)
            flat = np.concatenate([np.empty(0, np.int32), *places])
            found = model.probabilities(flat, starts) if model else np.zeros((len(places), len(names)))
            limit = model.limit if model else 2.0
            out = {"doc_id": batch["doc_id"]} | {f"p_{n}": found[:, i] for i, n in enumerate(names)}
            yield pd.DataFrame(out | {"toxic": found[:, -1] >= limit})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id string, " + ", ".join(f"p_{n} double" for n in names) + ", toxic boolean"
    return rows.mapInPandas(score, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
