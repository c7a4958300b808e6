"""Language identification with string kernels.

The kernel of two texts is the mean, over the n-gram orders of the spectrum, of the cosine of their n-gram presence
sets. Landmark texts span a Nyström approximation, and one kernel ridge regression per language is fitted in it, on a
bounded sample of labelled rows. Texts are scored in batches: presence matrix times landmarks times coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Orders of the blended spectrum.
ORDERS = (1, 2, 3)
#: Bounds of the fitted sample: landmark and training texts per language, and languages.
LANDMARKS_PER_LANGUAGE = 24
TRAINING_PER_LANGUAGE = 400
MAX_LANGUAGES = 500
#: Longer texts are predicted but not learnt from: the sample stays small.
TRAINING_CHARS = 50_000
RIDGE = 1e-3
UNKNOWN = "und"
_BATCH = 128


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, set(text)))


def grams(text: str, order: int) -> np.ndarray:
    """Sorted codes of the distinct n-grams of a text, lower-cased; 21 bits a character."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(points) < order:
        return np.empty(0, dtype=np.uint64)
    codes = points[: len(points) - order + 1].copy()
    for i in range(1, order):
        codes = (codes << np.uint64(21)) | points[i : len(points) - order + 1 + i]
    codes |= np.uint64(order - 1) << np.uint64(62) if order < 3 else np.uint64(0)
    return np.unique(codes)


@dataclass
class Model:
    """Known n-grams, the landmarks over them, and a coefficient per landmark and language."""

    codes: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]


def presence(texts: list[str], codes: np.ndarray) -> np.ndarray:
    """One row per text over the known n-grams; entries make the product of two rows their kernel."""
    out = np.zeros((len(texts), len(codes)), dtype=np.float32)
    for row, text in enumerate(texts):
        for order in ORDERS:
            own = grams(text, order)
            if len(own):
                at = np.searchsorted(codes, own)
                at[at == len(codes)] = 0
                out[row, at[codes[at] == own]] = 1 / np.sqrt(len(own) * len(ORDERS))
    return out


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE) -> Model | None:
    """Fit on labelled texts, whose first ``landmarks`` of each language span the approximation; None without texts."""
    names = sorted(set(languages))
    if not names:
        return None
    label = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(label == i)[:landmarks] for i in range(len(names))])
    spans = [texts[i] for i in chosen]
    codes = np.unique(np.concatenate([grams(t, order) for t in spans for order in ORDERS]))
    basis = presence(spans, codes)
    kernel = np.concatenate([presence(texts[i : i + _BATCH], codes) @ basis.T for i in range(0, len(texts), _BATCH)]).astype(np.float64)
    target = np.eye(len(names))[label]
    balance = 1 / np.bincount(label)[label]
    weighted = kernel * balance[:, None]
    inner = (basis @ basis.T).astype(np.float64)
    gram = kernel.T @ weighted + RIDGE * inner + 1e-9 * np.eye(len(spans))
    weights = np.linalg.lstsq(gram, weighted.T @ target, rcond=None)[0]
    return Model(codes, basis, weights.astype(np.float32), names)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", seed: str = "doc_id") -> Model | None:
    """Fit on at most TRAINING_PER_LANGUAGE rows per language with a letter, those of the smallest hashes of ``seed``.

    The hash only picks the sample. Hash limits per language are found on two narrow columns first.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit(11), seed).alias("h")
    )
    counts = labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    keep = F.lit(False)
    for row in counts:  # at most MAX_LANGUAGES; three times the sample, for rows without letters and uneven hashes
        share = min(1.0, 3 * TRAINING_PER_LANGUAGE / row["count"])
        keep = keep | ((F.col("lang") == row["lang"]) & (F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))))
    few = rows.where(keep & (F.length("text") <= TRAINING_CHARS))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    sample = ranked.where(F.col("r") <= TRAINING_PER_LANGUAGE).orderBy("lang", "r").collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1); und and 0 for null, empty and letterless texts, and without a model.

    Whole texts are scored. Equal texts get equal results; ties go to the first language by name. Input columns named
    lang_pred or score are replaced.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            texts = batch.tolist()
            names, scores = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if has_letter(t)] if known else []
            for low in range(0, len(rows), _BATCH):
                part = rows[low : low + _BATCH]
                values = presence([texts[i] for i in part], known.codes) @ known.landmarks.T @ known.weights
                names[part] = np.array(known.languages, dtype=object)[values.argmax(axis=1)]
                scores[part] = np.clip(values.max(axis=1), 0, 1)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    scored = docs.select(*others, score(F.col(text)).alias("_quire_scored"))
    return scored.select(*others, "_quire_scored.lang_pred", "_quire_scored.score")


def held_out(doc_id: str = "doc_id"):
    """The third of the documents that is never learnt from; a null doc_id is neither learnt from nor held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and predict all; adds held_out, lang_pred and score."""
    model = train(docs.where(~held_out()))
    return predict(docs.drop("held_out").withColumn("held_out", F.coalesce(held_out(), F.lit(False))), model)
