"""Line dedup by a log-template tree.

Every line is parsed as a log record: by its number of tokens, then by its leading tokens, down to a leaf of fixed
depth. A token with a digit is a variable field at once. Below the leaf a template is the sequence of tokens, and,
for lines of 12 tokens or more, also what is left of it when the tokens of one third of the positions (every third
from the first, second or third) are taken for variable fields. Sentences of 8 tokens or more inside lines are records
too, so a passage set into the middle of a line is found.

A template recurs when enough documents of different make have it. The makes of a document are its first three
words and its last three outside the record judged, with its number of lines; each counts once, however many documents
have it. Copies of one document mostly share one or the other with the original; a template of which hardly any two
makes are met outside its commonest first and last ones is a document's own text, left to near-duplicate removal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.paritysketch import C1, C2, GOLD, _powers, hashed, mix

DEPTH = 3
OTHERS = 8
LEAST_LINE, LEAST_SENTENCE, LEAST_GENERAL = 3, 8, 12
FIELD = np.uint64(0x5851F42D4C957F2D)
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


@dataclass
class Records:
    """The records of some texts: per record its text, its bytes there, whether it is a whole line, and its template keys
    (exact, and by the third taken for fields; 0 where there is none), and the makes of its text by the first and last words
    outside it."""

    owner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    whole: np.ndarray
    keys: np.ndarray
    makes: np.ndarray


def parse(texts: list[str]) -> Records:
    """All texts at once, a line feed after each, so that the work is on long arrays."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    joined = b"\n".join(encoded) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    at_text = np.cumsum(lengths + 1) - lengths - 1
    gap = np.concatenate([[True], BLANK[raw], [True]])
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    n = len(start)
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    n_lines = (feeds[at_text + lengths] - feeds[at_text] + 1).astype(np.uint64)
    text = np.searchsorted(at_text, start, "right") - 1
    words = hashed(raw, start, end)
    digits = np.concatenate([[0], np.cumsum(DIGIT[raw])])
    words = np.where(digits[end] > digits[start], FIELD, words)

    if n == 0:
        none = np.zeros(0, np.int64)
        return Records(none, none, none, none.astype(bool), np.zeros((0, 4), np.uint64), np.zeros((0, 2), np.uint64))
    first_word, past = np.searchsorted(text, np.arange(len(texts))), np.searchsorted(text, np.arange(len(texts)), "right")

    def outside(first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> np.ndarray:
        head, tail = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
        begin, stop, size = first_word[owner], past[owner], last - first
        for k, factor in enumerate((GOLD, C1, C2)):
            there = begin + k + size < stop
            at = np.where(begin + k < first, begin + k, begin + k + size)
            head[there] += words[at[there]] * factor
            at = np.where(stop - 1 - k >= last, stop - 1 - k, stop - 1 - k - size)
            tail[there] += words[at[there]] * factor
        return mix(np.stack([head, tail], axis=1) + mix(n_lines[owner])[:, None])

    new_line = np.diff(feeds[start], prepend=-1) != 0
    stop = np.isin(raw[end - 1], (33, 46, 63))
    new_sentence = new_line | np.concatenate([[True], stop[:-1]])
    power, inverse = _powers(1 << max(16, n.bit_length()))
    weighted = mix(words ^ C2) * power[:n]
    sums = np.zeros((4, n + 1), np.uint64)
    np.cumsum(weighted, out=sums[0, 1:])
    for k in range(3):
        part = np.zeros(n, np.uint64)
        part[k::3] = weighted[k::3]
        np.cumsum(part, out=sums[k + 1, 1:])
    leads = np.zeros(n, np.uint64)  # of a record that begins at each word and has DEPTH tokens at least
    for k in range(min(DEPTH, n)):
        leads[: n - DEPTH + 1] = leads[: n - DEPTH + 1] * GOLD + words[k : max(0, n - DEPTH + 1) + k]

    def table(first: np.ndarray, whole: bool, least: int) -> tuple[np.ndarray, ...]:
        last = np.append(first[1:], n)
        ok = last - first >= least
        first, last = first[ok], last[ok]
        size = last - first
        at = mix(leads[first] + size.astype(np.uint64) * C1 + np.uint64(whole))
        keys = np.zeros((len(first), 4), np.uint64)
        total = sums[0, last] - sums[0, first]
        keys[:, 0] = mix(at ^ total * inverse[first])
        for k in range(3 * whole):
            field = 1 + (first + k) % 3  # the third of positions that begins at the k-th
            left = total - (sums[field, last] - sums[field, first])
            keys[:, k + 1] = np.where(size >= LEAST_GENERAL, mix(at ^ mix(left * inverse[first] + np.uint64(k + 1))), 0)
        owner = text[first]
        return owner, start[first] - at_text[owner], end[last - 1] - at_text[owner], np.full(len(first), whole), keys, outside(first, last, owner)

    both = (table(np.flatnonzero(new_line), True, LEAST_LINE), table(np.flatnonzero(new_sentence), False, LEAST_SENTENCE))
    return Records(*(np.concatenate(x) for x in zip(*both)))


def groups(texts: list[str], size: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts): together up to `size`, a longer text alone."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        if i > first and total + len(text) > size:
            yield first, texts[first:i]
            first, total = i, 0
        total += len(text)
    if texts:
        yield first, texts[first:]


def without(text: str, spans: list[tuple[int, int, bool]]) -> tuple[str, int, int]:
    """(text without the records of these bytes, lines dropped, sentences dropped)."""
    raw = text.encode("utf-8", "replace")
    cuts = []
    for a, b, whole in spans:
        if whole:
            a = raw.rfind(b"\n", 0, a) + 1
            end = raw.find(b"\n", b)
            b = len(raw) if end < 0 else end + 1
        else:
            while b < len(raw) and raw[b] in b" \t":
                b += 1
        cuts.append((a, b))
    out, at = [], 0
    for a, b in sorted(cuts):
        if a > at:
            out.append(raw[at:a])
        at = max(at, b)
    out.append(raw[at:])
    lines = sum(whole for *_, whole in spans)
    left = b"".join(out).decode()
    if lines < len(spans) and all(x.strip() for x in raw.split(b"\n")):
        left = "\n".join(x for x in left.split("\n") if x.strip())  # lines of which every sentence went
    if lines and left.endswith("\n") and not raw.endswith(b"\n"):
        left = left[:-1]
    return left, lines, len(spans) - lines


def recurring(docs: DataFrame, least: int = 5) -> DataFrame:
    """`(key)` of templates that documents of at least `least` makes by first or last words have; of their distinct pairs of
    makes, one of OTHERS at least has neither the commonest first nor the commonest last one. Staged.

    Tasks count a pair once; one shuffle by template then serves both ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2000):
            keys, makes = [], []
            for _, group in groups(batch["text"].to_pylist()):
                found = parse(group)
                row, column = np.nonzero(found.keys)
                key, owner = found.keys[row, column], found.owner[row]
                order = np.lexsort((owner, key))  # a text counts once for a template
                key, owner, row = key[order], owner[order], row[order]
                once = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(owner) != 0)])[: len(key)]
                keys.append(key[once])
                makes.append(found.makes[row[once]])
            key, make = np.concatenate(keys), np.concatenate(makes)
            order = np.lexsort((make[:, 1], make[:, 0], key))
            key, make = key[order], make[order]
            first = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(make, axis=0) != 0).any(axis=1)])[: len(key)]
            yield pa.RecordBatch.from_pydict({"key": key[first].view(np.int64), "head": make[first, 0].view(np.int64), "tail": make[first, 1].view(np.int64)})

    met = common.texts(docs).select("text").mapInArrow(run, "key bigint, head bigint, tail bigint")
    pairs = met.repartition("key").groupBy("key", "head", "tail").agg(F.lit(1).alias("one"))
    ends = pairs.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("end"), F.col(c).alias("make")) for i, c in enumerate(("head", "tail"))])).alias("m")).select("key", "m.*")
    by_make = ends.groupBy("key", "end", "make").agg(F.count(F.lit(1)).alias("n"))
    by_end = by_make.groupBy("key", "end").agg(F.count(F.lit(1)).alias("makes"), F.sum("n").alias("n"), F.max("n").alias("most"))
    found = by_end.groupBy("key").agg(F.max("makes").alias("makes"), F.max("n").alias("n"), F.sum("most").alias("most"))
    return common.staged(found.where(f"makes >= {least} and {OTHERS} * (n - most) >= n").select("key"), "templates")


def flagged(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """`(row, found)`: for rows that have recurring templates, the bytes of those records; `row` stands for (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = batch["key"].to_numpy()
            for first, group in groups(batch["text"].to_pylist()):
                r = parse(group)
                row, column = np.nonzero(r.keys)
                yield pa.RecordBatch.from_pydict({
                    "row": rows[first + r.owner[row]], "key": r.keys[row, column].view(np.int64), "begin": r.begin[row].astype(np.int64), "end": r.end[row].astype(np.int64), "whole": r.whole[row]})

    rows = common.texts(docs).select(common.row_key().alias("key"), "text").mapInArrow(run, "row bigint, key bigint, begin bigint, end bigint, whole boolean")
    return rows.join(templates, "key").groupBy("row").agg(F.collect_set(F.struct("begin", "end", "whole")).alias("found"))


def deduplicated(docs: DataFrame, least: int = 5) -> DataFrame:
    """All rows with their columns, `text` without recurring lines and sentences, and `n_chars`, where there is one, its new
    length. Texts without any stay byte for byte; `dropped_lines` and `dropped_sentences` are added.

    No row goes, even if nothing is left of its text. A null text stays null; rows that agree in id and text get equal
    results; an empty table gives an empty one; of other columns none is read.
    """
    marks = flagged(docs, recurring(docs, least))
    keyed = docs.withColumn("_template_row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    joined = keyed.join(marks.select(F.col("row").alias("_template_row"), F.col("found").alias("_template_found")), "_template_row", "left").drop("_template_row")
    names = [c for c in joined.columns if c not in ("_template_found",)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*[f"`{c}`" for c in names]).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            text = batch["text"].to_pylist()
            lines, sentences = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
            for i, found in enumerate(batch["_template_found"].to_pylist()):
                if found:
                    text[i], lines[i], sentences[i] = without(text[i], [(f["begin"], f["end"], f["whole"]) for f in found])
            columns = {c: batch[c] for c in names} | {"text": pa.array(text, pa.string()), "_template_lines": lines, "_template_sentences": sentences}
            yield pa.RecordBatch.from_pydict(columns)

    out = joined.mapInArrow(run, f"{schema}, _template_lines bigint, _template_sentences bigint")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_template_lines") + F.col("_template_sentences") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns], F.col("_template_lines").alias("dropped_lines"), F.col("_template_sentences").alias("dropped_sentences"))
