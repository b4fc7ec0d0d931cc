"""N-gram Jaccard join by parity sketches.

Every document is the set of its distinct 5-word shingles. A shingle toggles one bit of a sketch, so the number of bits
in which two sketches differ is at most the size of the sets' symmetric difference, which for sets of a and b shingles
with similarity of at least 0.8 is at most (a + b) / 9.

Sets are joined by pigeonhole within bands of size: the shingles of a set are dealt by their hash into k segments, more
than two linked sets of the band can differ in, and each segment's shingles are XORed into one 64-bit signature. Linked
sets agree in some segment of two shingles or more (one, for small sets), so they meet on its signature, while a passage
that two texts share rarely fills a segment alone. Sets that meet are compared by sketch, and those left by their shingles.

Sets of the same shingles are one class from the start. Sets that meet on a signature are first compared with one of
them, the one that shares most signatures, and of several such leaders with one first; then, for signatures whose sets are not all connected yet, sets of different components
are compared, so no pair that meets goes unexamined and a group of copies costs about as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.components import components

PERCENT = 80
SIZE = 5
SEEDS = 5
WORDS = 16  # of 64 bits in a sketch
SEPARATORS = np.array([32, 9, 10, 11, 12, 13], np.uint8)
C1, C2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, capital ASCII letters sharing those of small ones; and which bytes separate words."""
    numbers = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    numbers[65:91] = numbers[97:123]
    blank = np.zeros(256, bool)
    blank[SEPARATORS] = True
    return numbers, blank


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(GOLD), pow(int(GOLD), -1, 1 << 64)):
        table = np.full(n, np.uint64(base))
        table[0] = 1
        out.append(np.cumprod(table, dtype=np.uint64))
    return out[0], out[1]


def hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, A-Z as a-z."""
    n = len(raw)
    power, inverse = _powers(1 << max(16, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_bytes()[0][raw] * power[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word of the text, in order."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(raw) == 0:
        return np.zeros(0, np.uint64)
    gap = np.concatenate([[True], _bytes()[1][raw], [True]])
    return hashed(raw, np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:]))


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashed shingles of a text, ascending; all words as one where they are fewer than five, none without words."""
    words = word_hashes(text or "")
    if len(words) == 0:
        return words
    size = min(SIZE, len(words))
    rolled = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        rolled = rolled * GOLD + words[k : k + len(rolled)]
    return np.unique(mix(rolled + np.uint64(size)))


def class_of(hashes: np.ndarray) -> int:
    """A 64-bit name of a set of shingles, the same in any order."""
    total = np.add.reduce(mix(hashes ^ GOLD)) + np.uint64(len(hashes))
    return int(mix(np.array([total]))[0].astype(np.int64))


def sketch(hashes: np.ndarray) -> list[int]:
    """1024 parities as sixteen signed 64-bit numbers."""
    bits = np.bincount((mix(hashes) >> np.uint64(54)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


@lru_cache(maxsize=1)
def _edges() -> np.ndarray:
    """Where each band of sizes begins, a band reaching to 1.5625 times that."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 25 // 16)))
    return np.array(out)


def signatures(hashes: np.ndarray) -> np.ndarray:
    """The signatures of a set: those of its own band, and of the next where sets there may be linked with it."""
    n, edges = len(hashes), _edges()
    if n == 0:
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(edges, n, "right")) - 1
    last = int(np.searchsorted(edges, n * 100 // PERCENT, "right")) - 1
    out = []
    for band in range(own, last + 1):
        # Two sets that meet here are smaller than the band's end.
        differ = 2 * int(edges[band + 1] - 1) * (100 - PERCENT) // (100 + PERCENT)
        if differ == 0:
            continue  # such sets are linked only if equal
        least, k = (1, differ + 2 + -(-differ // 10)) if differ < 8 else (2, differ + 3 + -(-3 * differ // 10))
        # How much this set can differ from one it is linked with here.
        apart = (n + min(n * 100 // PERCENT, int(edges[band + 1]) - 1)) * (100 - PERCENT) // (100 + PERCENT)
        for seed in range(SEEDS + 1):
            salt = np.uint64(((band * 64 + seed) * 2 + 1) * int(GOLD) % (1 << 64))
            if seed == SEEDS:
                # No dealing left this set enough segments that are full enough; such sets of a band all meet.
                out.append(mix(np.array([salt])))
                break
            dealt = hashes if seed == 0 else np.sort(mix(hashes ^ salt))
            # The high bits say the segment, so segments of ascending hashes ascend.
            segment = ((dealt >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            first = np.flatnonzero(np.diff(segment, prepend=segment[:1] + np.uint64(1)))
            full = np.diff(np.append(first, n)) >= least
            folded = np.bitwise_xor.reduceat(mix(dealt ^ C2), first)
            out.append(mix(folded ^ mix(segment[first] * C1 + salt))[full])
            # Of k segments at least k - apart agree; with that many not full they might all be among those.
            if full.sum() > apart:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets(docs: DataFrame) -> DataFrame:
    """`(doc_id, key, n_shingles, class)` for every row, `key` standing for (doc_id, text); class is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [shingles(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "key": batch["key"], "n_shingles": pa.array([len(h) for h in found], pa.int64()), "class": pa.array([class_of(h) if len(h) else None for h in found], pa.int64())})

    rows = common.texts(docs).withColumn("key", common.row_key())
    return rows.mapInArrow(run, "doc_id bigint, key bigint, n_shingles bigint, class bigint")


def _signed(docs: DataFrame) -> DataFrame:
    """`(sig, class, n)`: each set's signatures; a class comes once from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.slices(batches):
            parts, classes, sizes = [], [], []
            for text in batch["text"].to_pylist():
                h = shingles(text)
                name = class_of(h) if len(h) else None
                if name is None or name in seen:
                    continue
                seen.add(name)
                parts.append(signatures(h))
                classes.append(name)
                sizes.append(len(h))
            counts = list(map(len, parts))
            if sum(counts):
                yield pa.RecordBatch.from_pydict({
                    "sig": np.concatenate(parts).view(np.int64), "class": np.repeat(np.array(classes, np.int64), counts), "n": np.repeat(np.array(sizes, np.int32), counts)})

    return common.texts(docs).select("text").mapInArrow(run, "sig bigint, class bigint, n int")


def _sketched(docs: DataFrame) -> DataFrame:
    """`(class, n, sketch, hashes)` of rows with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 200):
            found = [h for h in map(shingles, batch["text"].to_pylist()) if len(h)]
            yield pa.RecordBatch.from_pydict({
                "class": pa.array([class_of(h) for h in found], pa.int64()), "n": pa.array([len(h) for h in found], pa.int32()),
                "sketch": pa.array([sketch(h) for h in found], pa.list_(pa.int64())), "hashes": pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))})

    return common.texts(docs).mapInArrow(run, "class bigint, n int, sketch array<bigint>, hashes array<bigint>")


def _may_link(a: str, b: str) -> Column:
    """What sizes and sketches allow."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    apart = sum(F.bit_count(F.get(f"sketch{a}", k).bitwiseXOR(F.get(f"sketch{b}", k))) for k in range(WORDS))
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    return sizes & (apart * (100 + PERCENT) <= (n + m) * (100 - PERCENT))


def _linked(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of `pairs (a, b)` those whose sets' similarity is high enough."""
    hashes = lambda c: known.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("hashes").alias(f"h{c}"))
    shared = F.size(F.array_intersect("ha", "hb"))
    both = pairs.join(hashes("a"), "a").join(hashes("b"), "b")
    return both.where(shared * 100 >= (F.col("na") + F.col("nb") - shared) * PERCENT).select("a", "b")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links `(a, b)` between classes that connect all classes any links connect. `rows` are `sets(docs)`, staged."""
    # Signatures that sets of two classes have. One shuffle of the signatures; what stays is about the near copies.
    group = W.partitionBy("sig")
    met = _signed(docs).withColumn("least", F.min("class").over(group)).withColumn("most", F.max("class").over(group)).where("least <> most")
    shared = common.staged(met.select("sig", "class").distinct(), "shared")
    # The texts of the classes that met, one row of each.
    needed = common.staged(rows.join(shared.select("class").distinct(), "class").groupBy("class").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "needed")
    known = common.staged(_sketched(docs.select("doc_id", "text").join(needed, "doc_id")).dropDuplicates(["class"]), "sketched")
    brief = known.select("class", "n", "sketch")
    side = lambda c: brief.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"sketch{c}"))
    degree = shared.groupBy("class").agg(F.count(F.lit(1)).alias("degree"))
    leaders = shared.join(degree, "class").groupBy("sig").agg(F.max(F.struct("degree", "class")).alias("l")).select("sig", F.col("l.class").alias("a"), "l.degree")
    star = shared.join(leaders, "sig").where("class <> a").groupBy("a", F.col("class").alias("b")).agg(F.max("degree").alias("degree"))
    tried = common.staged(star.join(side("a"), "a").join(side("b"), "b").where(_may_link("a", "b")).select("a", "b", "degree"), "tried")
    # First each class with one leader, the best; with its other leaders only if that has not connected them.
    best = tried.groupBy("b").agg(F.max(F.struct("degree", "a"))["a"].alias("a"))
    first = common.staged(_linked(best, known), "links")
    roots = components(first)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root{c}"))
    left = tried.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("roota", "a") != F.coalesce("rootb", "b")).select("a", "b")
    first = common.staged(first.union(_linked(left.join(best, ["a", "b"], "left_anti"), known)), "links")
    roots = components(first)
    rooted = shared.join(roots, shared["class"] == roots["node"], "left").select("sig", "class", F.coalesce("root", "class").alias("root"))
    mixed = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sig")
    open_ = common.staged(rooted.join(mixed, "sig").join(brief, "class"), "open")
    one, two = (open_.select("sig", F.col("class").alias(c), F.col("root").alias(f"root{c}"), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"sketch{c}")) for c in "ab")
    rest = one.join(two, "sig").where((F.col("roota") < F.col("rootb")) & _may_link("a", "b")).select("a", "b").distinct()
    second = common.staged(_linked(rest, known), "links")
    return first.union(second)


def placed(docs: DataFrame) -> DataFrame:
    """`(doc_id, key, n_shingles, component_id)`; see `grouped`."""
    rows = common.staged(sets(docs), "sets")
    roots = components(links(docs, rows))
    named = rows.where("class is not null").select("doc_id", "class").join(roots, F.col("class") == F.col("node"), "left")
    least = named.groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("doc_id").alias("component"))
    of_class = named.select("class", F.coalesce("root", "class").alias("root")).distinct().join(least, "root").select("class", "component")
    return rows.join(of_class, "class", "left").select("doc_id", "key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def grouped(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` for every row; the component is the least doc_id reachable by links, itself included.

    A null or empty text, or one without words, has no shingles and is linked with nothing; a row without id keeps a null
    component unless rows with ids share it; equal texts are linked; rows of one id are rows of their own; an empty table
    gives an empty one; other columns stay behind.
    """
    return placed(docs).drop("key")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that stay when of each component only the least doc_id does, with all their columns. Documents without
    words all stay, as do rows without id unless they are linked with a row that has one; rows that agree in id and text
    stay or go together."""
    gone = placed(docs).where("n_shingles > 0 and component_id is not null and not (component_id <=> doc_id)").select(F.col("key").alias("_gone_key")).distinct()
    keyed = docs.withColumn("_gone_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return keyed.join(common.staged(gone, "gone"), "_gone_key", "left_anti").select(*[f"`{c}`" for c in docs.columns])
