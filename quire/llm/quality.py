"""Quality rules and an isolation forest over their statistics.

Each text gets rule statistics. Trees split bounded samples of them at random; rows that few splits isolate are
anomalous. The limit on the anomaly is calibrated on labelled rows. Fixed base rules fail a text on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import store

TREES = 64
#: Rows of one tree; the sample of the forest holds TREES times as many.
TREE_ROWS = 256
#: Good labelled rows that the calibrated limit may lose.
LOST_GOOD = 0.01
BINS = 1000
BLANKS = " \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, at, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    hit = times[at] > 1
    inside = np.zeros(len(words), dtype=bool)
    for i in range(3):
        inside[i : len(words) - 2 + i] |= hit
    return int(inside.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    body = text or ""
    data = body.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = len(body) - sum(map(body.count, BLANKS))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(data) - len(data.translate(None, b"!?=_~^@{}[]\\/"))
    symbols = sum(map(body.count, "#*$%&|<>"))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, marks


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks) per row."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([statistics(t) for t in batch["text"].tolist()], dtype=np.int64).reshape(-1, len(STATS))
            yield pd.DataFrame({"doc_id": batch["doc_id"]} | {name: values[:, i] for i, name in enumerate(STATS)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInPandas(measure, "doc_id string, " + ", ".join(f"{s} bigint" for s in STATS))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def features(stats: pd.DataFrame) -> np.ndarray:
    """Ratios that do not grow with the text."""
    words, chars = np.maximum(stats["n_words"], 1).to_numpy(float), np.maximum(stats["word_chars"], 1).to_numpy(float)
    return np.column_stack([
        chars / words, stats["n_symbols"] / words, stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1),
        stats["n_repeat_words"] / words, stats["n_upper"] / chars, stats["n_marks"] / words,
    ])


def _path_end(n: int) -> float:
    """Mean path length among ``n`` rows that were not split further."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, seed: int) -> list[tuple[int, float, int, float]]:
    """A tree of random splits as (feature, limit, right child, path length of a leaf); the left child follows its parent."""
    random, depth = np.random.default_rng(seed), int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list[tuple[int, float, int, float]] = []

    def split(part: np.ndarray, level: int) -> None:
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
        choices = np.flatnonzero(high > low)
        if level >= depth or len(part) < 2 or not len(choices):
            nodes.append((-1, 0.0, -1, level + _path_end(len(part))))
            return
        feature = int(random.choice(choices))
        limit = float(random.uniform(low[feature], high[feature]))
        at = len(nodes)
        nodes.append((feature, limit, -1, 0.0))
        left = part[:, feature] < limit
        split(part[left], level + 1)
        nodes[at] = (feature, limit, len(nodes), 0.0)
        split(part[~left], level + 1)

    split(rows, 0)
    return nodes


class Forest:
    def __init__(self, sample: np.ndarray):
        self.scale = _path_end(min(TREE_ROWS, len(sample))) or 1.0
        order = np.random.default_rng(0).permutation(len(sample))
        parts = [order[i * len(sample) // TREES : (i + 1) * len(sample) // TREES] for i in range(TREES)]
        self.trees = [tuple(map(np.array, zip(*grow(sample[p[:TREE_ROWS]], i), strict=True))) for i, p in enumerate(parts)]

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1: two to the power of minus the mean path length over that of a random tree."""
        total = np.zeros(len(rows))
        for feature, limit, right, length in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                node = at[inner]
                at[inner] = np.where(rows[inner, feature[node]] < limit[node], node + 1, right[node])
            total += length[at]
        return 2.0 ** (-total / TREES / self.scale)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Statistics, base_failed, anomaly and kept per row of ``docs``.

    The forest grows on the TREES * TREE_ROWS rows of smallest hash; the limit loses at most LOST_GOOD of the labelled
    good rows that pass the base rules, and below that bound takes the best balance of good and bad. Without labels of
    both kinds nothing is anomalous. Null and empty texts have no words and fail the base rules. Null or repeated ids
    in ``labels`` are harmless: nulls match nothing, and a doc_id counts as bad where any of its labels does.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = store(with_statistics(docs, text).withColumn("base_failed", base))
    order = F.xxhash64(F.lit(3), "doc_id", *STATS)
    # only rows below a hash that about twice as many reach are sorted: a task sends few of them to the driver
    share = 2 * TREES * TREE_ROWS / max(1, rows.count())
    low = rows if share >= 1 else rows.where(order < F.lit(int((share - 0.5) * (1 << 64))))
    sample = low.select(*STATS, order.alias("_order")).orderBy("_order", *STATS).limit(TREES * TREE_ROWS).drop("_order").toPandas()
    forest = Forest(features(sample)) if len(sample) else None
    grown = docs.sparkSession.sparkContext.broadcast(forest)  # bounded by the sample

    @F.pandas_udf("double")
    def anomaly(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(grown.value.anomaly(features(stats)))

    scored = store(rows.withColumn("anomaly", anomaly(F.struct(*STATS))))
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counted = (
        scored.where("not base_failed").join(known, "doc_id").groupBy("quality", F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).count().collect()
    )  # at most two rows a bin
    limit = calibrate([(r["quality"], r["bin"], r["count"]) for r in counted])
    return scored.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS) < limit))


def calibrate(counts: list[tuple[int, int, int]]) -> int:
    """The first anomalous bin."""
    hist = np.zeros((2, BINS + 1))
    for quality, bin_, n in counts:
        hist[int(quality > 0), bin_] += n
    above = hist[:, ::-1].cumsum(axis=1)[:, ::-1] / np.maximum(hist.sum(axis=1, keepdims=True), 1)  # share at or above a bin
    if not hist.sum(axis=1).all():
        return BINS + 1
    gain = np.where(above[1] <= LOST_GOOD, above[0] - above[1], -1)
    return int(gain.argmax()) if gain.max() > 0 else BINS + 1
