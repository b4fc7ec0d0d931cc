"""Toxicity from subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams, blanks at its ends included; n-grams share hashed vectors, so a spelling
never seen before still lands near its relatives. The distinct words of a window of 16 are averaged (over 16, however
few they are) into a linear softmax, and a document is as toxic as its most toxic window. Vectors and softmax are trained together in numpy.
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

BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
WINDOW = 16
# Code points scored at a time.
SCORED = 1 << 17
# In training: code points cut into n-grams at a time, windows or n-grams summed at a time.
PART, BLOCK, GRAMS = 1 << 16, 1 << 13, 1 << 19


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """A random number for each letter or digit, 1 for everything else (a blank)."""
    numbers = np.random.default_rng(77).integers(2, 2**63, pieces.POINTS, dtype=np.uint64)
    numbers[pieces.kinds() >= pieces.SPACE] = 1
    return numbers


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all words of lower-cased texts: (bucket of each n-gram in order of its word; where each word's
    begin; number of the text of each word; a 64-bit hash of each word)."""
    low = [t.lower() for t in texts]
    # A blank before and after each text closes its words.
    points = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _codes()[points]
    blank = code == 1
    n = len(code)
    length = np.fromiter(map(len, low), np.int64, len(low))
    text_end = np.cumsum(length + 2)
    begin = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before each word
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1  # the blank after it
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    owner = np.searchsorted(text_end, begin, "right")
    word = np.cumsum(np.concatenate([[False], blank[:-1] & ~blank[1:]])) - 1
    word[begin] = np.arange(len(begin))
    until = np.zeros(n, np.int64)  # for each place inside a word, the blank that ends it
    inside = ~blank
    inside[begin] = True
    until[inside] = end[word[inside]]
    found, of = [], []
    place = np.flatnonzero(inside)
    rolling = code[place].copy()
    for k in range(2, max(SIZES) + 1):
        keep = place + k - 1 <= until[place]
        place, rolling = place[keep], rolling[keep]
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + code[place + k - 1]
        if k in SIZES:
            mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((mixed >> np.uint64(64 - 17)).astype(np.int32))
            of.append(word[place])
    # Every word has at least one: a word of one letter with its blanks is a 3-gram.
    bucket, words = np.concatenate(found), np.concatenate(of)
    order = np.argsort(words, kind="stable")
    bucket = bucket[order]
    sizes = np.bincount(words, minlength=len(begin))
    # Words are known again by the sum and product of their n-grams' numbers.
    spread = _codes()[bucket.astype(np.int64) + 40]
    first = np.cumsum(sizes) - sizes
    hashes = np.add.reduceat(spread * (bucket.astype(np.uint64) + np.uint64(3)), first)
    return bucket, first, owner, hashes


@dataclass
class Model:
    """`score[b]` is what the n-gram of bucket b adds to the softmax's logit (toxic minus clean), its vector already
    multiplied by the difference of the two output weights: averaging and the softmax's scores are linear."""

    score: np.ndarray
    bias: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """One logit per text: its highest window; a text without words gets the bias. In a text of more than `SCORED` code
        points windows begin anew about every so many."""
        out = np.full(len(texts), np.nan)
        for first, last, group in common.chunks(texts, SCORED):
            bucket, begin, owner, hashes = grams(group)
            if len(begin):
                value = np.add.reduceat(self.score[bucket].astype(np.float64), begin) / np.diff(np.append(begin, len(bucket)))
                heads = np.flatnonzero(np.diff(owner, prepend=-1))
                within = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
                start = within % WINDOW == 0
                row = np.cumsum(start) - 1
                words, values = np.zeros((row[-1] + 1, WINDOW), np.uint64), np.zeros((row[-1] + 1, WINDOW))
                words[row, within % WINDOW], values[row, within % WINDOW] = hashes, value
                order = np.argsort(words, axis=1)
                words, values = np.take_along_axis(words, order, 1), np.take_along_axis(values, order, 1)
                values[:, 1:][words[:, 1:] == words[:, :-1]] = 0  # a word counts once in a window
                np.fmax.at(out, first + owner[start], values.sum(axis=1) / WINDOW + self.bias)
        return np.where(np.isnan(out), self.bias, out)


@dataclass
class _Sample:
    """Training input: the n-grams of each distinct word one after the other (`flat`, with the word of each), words in
    how many texts, and all windows as rows of 16 word numbers, the number of words where a row has no more."""

    flat: np.ndarray
    word_of_gram: np.ndarray
    texts_with: np.ndarray
    windows: np.ndarray
    text_of: np.ndarray


def _encoded(texts: list[str]) -> _Sample:
    """All windows of every text. `texts` is emptied: a text is let go once its words are numbered."""
    seen: dict[int, int] = {}
    flat, sizes, windows, text_of = [], [], [], []
    texts_with = np.zeros(1 << 12, np.int32)

    def close(at: int, parts: list[np.ndarray]) -> None:
        nonlocal texts_with
        ids = np.concatenate(parts)
        if len(seen) > len(texts_with):
            texts_with = np.concatenate([texts_with, np.zeros(len(seen), np.int32)])
        texts_with[np.unique(ids)] += 1
        rows = np.full(-(-len(ids) // WINDOW) * WINDOW, -1, np.int32)
        rows[: len(ids)] = ids
        rows = np.sort(rows.reshape(-1, WINDOW), axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1  # a word counts once in a window
        windows.append(rows)
        text_of.append(np.full(len(rows), at, np.int32))

    open_at, open_parts = -1, []
    for first, _, group in common.chunks(texts, PART):
        bucket, begin, owner, hashed = grams(group)
        for k in range(first, first + len(group)):
            texts[k] = ""
        if not len(begin):
            continue
        length = np.diff(np.append(begin, len(bucket)))
        unique, at, back = np.unique(hashed, return_index=True, return_inverse=True)
        number = np.empty(len(unique), np.int32)
        fresh = []
        for j, h in enumerate(unique.tolist()):
            k = seen.get(h)
            if k is None:
                k = seen[h] = len(seen)
                fresh.append(at[j])
            number[j] = k
        for i in fresh:
            flat.append(bucket[begin[i] : begin[i] + length[i]].tobytes())
        if len(fresh):
            flat = [b"".join(flat)] if len(flat) > 1 << 14 else flat
            sizes.append(length[fresh].astype(np.int32))
        ids = number[back]
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(owner)).tolist()):
            text = first + int(owner[a])
            if text != open_at and open_parts:
                close(open_at, open_parts)
                open_parts = []
            open_at = text
            open_parts.append(ids[a:b])
    if open_parts:
        close(open_at, open_parts)
    n_words = len(seen)
    every = np.concatenate(windows) if windows else np.zeros((0, WINDOW), np.int32)
    every[every < 0] = n_words
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
    owner = np.concatenate(text_of) if text_of else np.zeros(0, np.int32)
    return _Sample(np.frombuffer(b"".join(flat), np.int32), np.repeat(np.arange(n_words, dtype=np.int32), size), texts_with[:n_words], every, owner)


def _summed(into: np.ndarray, out_of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of `values` numbered `out_of`, added up under the numbers `into`, some at a time."""
    out = np.zeros((n, values.shape[1]))
    for a in range(0, len(into), GRAMS):
        some, rows = into[a : a + GRAMS], out_of[a : a + GRAMS]
        for k in range(values.shape[1]):
            out[:, k] += np.bincount(some, values[rows, k], n)
    return out


def fit(texts: list[str], labels: list[int], dim: int = 4, epochs: int = 50, rate: float = 0.6, least: int = 8, decay: float = 3e-7, seed: int = 5) -> Model:
    """Train on whole texts with labels 0 and 1; `texts` is emptied. Without both labels every text gets the share of label 1.

    The first quarter of the epochs spreads a text's label over its windows; then each text is judged by its most
    toxic window, as in scoring. Softmax loss with `decay` on the vectors, Adam steps over all texts. N-grams of fewer
    than `least` texts keep a zero vector: they say nothing about texts to come. All windows are held, 64 bytes each;
    what is worked out from them is held for `BLOCK` windows or `GRAMS` n-grams.
    """
    y = np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    sample = _encoded(texts)
    windows, win_text, n_words = sample.windows, sample.text_of, len(sample.texts_with)
    if not len(win_text):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(y.mean() / (1 - y.mean()))))
    rng = np.random.default_rng(seed)
    flat, word_of_gram = sample.flat, sample.word_of_gram
    gram_sizes = np.maximum(np.bincount(word_of_gram, minlength=n_words), 1)[:, None]
    # Only buckets of enough texts are trained.
    in_texts = np.zeros(BUCKETS)
    for a in range(0, len(flat), GRAMS):
        in_texts += np.bincount(flat[a : a + GRAMS], sample.texts_with[word_of_gram[a : a + GRAMS]], BUCKETS)
    used = np.flatnonzero(in_texts >= least)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    flat = place[flat]
    kept = flat >= 0
    flat, word_of_gram = flat[kept], word_of_gram[kept]
    del sample, in_texts, kept
    vectors = rng.normal(0, 0.05, (len(used), dim)).astype(np.float32)
    output, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    state = [np.zeros_like(p) for p in (vectors, vectors, output, output, bias, bias)]
    balance = np.full(len(y), 1 / len(y))
    per_text = np.bincount(win_text, minlength=len(y))
    heads = np.flatnonzero(np.diff(win_text, prepend=-1))
    counts = np.diff(np.append(heads, len(win_text)))
    blocks = [(a, min(a + BLOCK, len(windows))) for a in range(0, len(windows), BLOCK)]
    mean = np.empty((len(windows), dim), np.float32)
    for epoch in range(epochs):
        word_vec = np.zeros((n_words + 1, dim), np.float32)  # the last stands for no word
        word_vec[:n_words] = _summed(word_of_gram, flat, vectors, n_words) / gram_sizes
        for a, b in blocks:
            mean[a:b] = word_vec[windows[a:b]].sum(axis=1) / np.float32(WINDOW)
        logit = mean @ output + bias
        gap = logit[:, 1] - logit[:, 0]
        p = 1 / (1 + np.exp(-gap))
        if epoch < epochs // 4:
            weight = balance[win_text] / per_text[win_text]
        else:
            top = np.maximum.reduceat(gap, heads)
            weight = np.where(gap == np.repeat(top, counts), balance[win_text], 0)
        error = ((p - y[win_text]) * weight).astype(np.float32)
        d_logit = np.stack([-error, error], axis=1)
        d_mean = (d_logit @ output.T) / np.float32(WINDOW)
        d_word = np.zeros((n_words + 1, dim))
        for a, b in blocks:
            touched = a + np.flatnonzero(weight[a:b] > 0)
            for k in range(dim if len(touched) else 0):
                d_word[:, k] += np.bincount(windows[touched].ravel(), np.repeat(d_mean[touched, k], WINDOW), n_words + 1)
        d_word = (d_word[:n_words] / gram_sizes).astype(np.float32)
        d_vec = _summed(flat, word_of_gram, d_word, len(used)).astype(np.float32) + np.float32(decay) * vectors
        grads = [d_vec, mean.T @ d_logit, d_logit.sum(axis=0)]
        for j, (value, grad) in enumerate(zip((vectors, output, bias), grads)):
            m, v = state[2 * j], state[2 * j + 1]
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            step = rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-7)
            value -= step.astype(np.float32) * (0.1 if j else 1)
    score = np.zeros(BUCKETS, np.float32)
    score[used] = vectors @ (output[:, 1] - output[:, 0])
    return Model(score, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, max_docs: int = 800) -> Model:
    """Fit on labelled documents for which `learnable` (over doc_id) holds: at most `max_docs` toxic and three times as many
    clean ones, those whose hashed id is least, so the choice does not hang on file order. Of the rows of one id the least
    text teaches. Rows with a null label, id or text teach nothing."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    rows = docs.select("doc_id", "text").where(learnable & F.col("text").isNotNull())
    picked = None
    for label in (0, 1):
        some = known.where(F.col("_toxic") == label).where(learnable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs if label else 3 * max_docs)
        picked = some if picked is None else picked.unionByName(some)
    sample = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("_toxic")).toPandas().sort_values("doc_id")
    texts, labels = sample["text"].tolist(), sample["_toxic"].tolist()
    del sample
    return fit(texts, labels)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, score, predicted)` for every row: the softmax's probability of label 1 and whether it is at least 0.5.

    A null or empty text, or one without letters or digits, has the score of the bias alone. Repeated rows score alike;
    an empty table gives an empty one; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**17 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            score = 1 / (1 + np.exp(-np.clip(shared.value.logits(batch["text"].to_pylist()), -500, 500)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": score, "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return common.texts(docs).mapInArrow(run, "doc_id bigint, score double, predicted int")


def rejected(docs: DataFrame, labels: DataFrame, learnable: Column | None = None) -> DataFrame:
    """Documents judged toxic are left out; the others keep all their columns. A score stands for a row's own text."""
    model = train(docs, labels, F.lit(True) if learnable is None else learnable)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in common.slices(batches):
            clean = shared.value.logits([t or "" for t in batch.column(at).to_pylist()]) < 0
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
