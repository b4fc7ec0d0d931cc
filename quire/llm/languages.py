"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text, blanks included, are hashed into buckets. Document
frequencies are counted over every text that may be learned from; the regression is fitted on a bounded sample by
follow-the-regularised-leader with an elastic-net penalty, then a temperature is set on texts it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common, pieces

BITS = 16
BUCKETS = 1 << BITS
SIZES = (1, 2, 3)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    numbers = np.random.default_rng(11).integers(2, 2**63, pieces.POINTS, dtype=np.uint64)
    kinds = pieces.kinds()
    numbers[kinds == pieces.SPACE] = 1
    numbers[kinds == pieces.NUMBER] = 3  # digits say nothing about a language
    return numbers


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in a whole text; none for a text without letters."""
    total = np.zeros(BUCKETS, np.int64)
    for part in common.parts(text):
        points = np.frombuffer((" " + part.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        code = _codes()[points]
        rolling = np.zeros(len(code), np.uint64)
        for k in range(1, max(SIZES) + 1):
            rolling = rolling[: len(code) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + code[k - 1 :]
            mixed = (rolling ^ (rolling >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(texts in which each bucket occurs, number of texts), over all rows of `(text)`. What comes to the driver is one
    number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(BUCKETS, np.int64), 0
        for batch in common.slices(batches):
            for text in batch["text"].to_pylist():
                found += counts(text) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"bucket": np.append(np.flatnonzero(found), BUCKETS), "n": np.append(found[found > 0], n)})

    rows = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out[:BUCKETS], int(out[BUCKETS])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (buckets, languages), most of them zero
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, TF-IDF values of unit length)."""
        found = counts(text)
        at = np.flatnonzero(found)
        value = (1 + np.log(found[at])) * self.idf[at]
        length = np.sqrt((value * value).sum())
        return at, value / length if length > 0 else value

    def raw(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ties go to the language first by name. A null text or one without letters is `und`
        with score 0, as is any text when no language was learned."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.raw(*self.features(text)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], found: np.ndarray, n: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3, seed: int = 3) -> Model:
    """FTRL-proximal over the texts in shuffled order, every fifth kept back to set the temperature."""
    names = sorted(set(langs))
    idf = np.log((1 + n) / (1 + found)) + 1
    model = Model(names, idf, np.zeros((BUCKETS, len(names))), np.zeros(len(names)))
    if len(names) < 2:
        return model
    y = np.searchsorted(names, langs)
    inputs = [model.features(t) for t in texts]
    order = np.random.default_rng(seed).permutation(len(texts))
    back, fitted = order[::5], np.array([i for k, i in enumerate(order) if k % 5])
    # The last bucket's row is the bias, without an L1 penalty.
    z, g2 = np.zeros((BUCKETS + 1, len(names))), np.zeros((BUCKETS + 1, len(names)))
    penalty = np.full((BUCKETS + 1, 1), l1)
    penalty[BUCKETS] = 0
    for _ in range(epochs):
        for i in fitted:
            at, value = np.append(inputs[i][0], BUCKETS), np.append(inputs[i][1], 1.0)
            zi, ni = z[at], g2[at]
            w = np.where(np.abs(zi) <= penalty[at], 0, -(zi - np.sign(zi) * penalty[at]) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = softmax(value @ w)
            p[y[i]] -= 1
            grad = value[:, None] * p[None, :]
            z[at] += grad - (np.sqrt(ni + grad * grad) - np.sqrt(ni)) / alpha * w
            g2[at] += grad * grad
    weights = np.where(np.abs(z) <= penalty, 0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(g2)) / alpha + l2))
    model.weights, model.bias = weights[:BUCKETS], weights[BUCKETS]
    if len(back):
        logits, truth = np.array([model.raw(*inputs[i]) for i in back]), y[back]
        steps = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(back)), truth], 1e-12)).mean() for t in steps]
        model.temperature = float(steps[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, learnable: Column, max_docs: int = 3000) -> Model:
    """Learn from rows with a text that has letters and a language, where `learnable` (over doc_id) holds. Document
    frequencies cover all of them; the regression is fitted on at most `max_docs`, those whose hashed id is least."""
    known = docs.select("doc_id", "text", "lang").where(learnable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found, n = frequencies(known)
    chosen = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select("doc_id").distinct()
    sample = known.join(F.broadcast(chosen), "doc_id").limit(2 * max_docs).toPandas().sort_values(["doc_id", "text", "lang"])
    return fit(sample["text"].tolist(), sample["lang"].tolist(), found, n)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, lang_pred, score)` for every row, by its text alone. A null or empty text, or one without a letter, is
    `und` with score 0. Repeated rows get equal results; an empty table gives an empty one; other columns stay behind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [shared.value.predict(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
