"""Importance resampling towards a target distribution over hashed n-grams of words.

The distinct words of a block of texts, each between two delimiters, make an Aho-Corasick dictionary; a word's payload
is the CRC-32 and byte length of a blank and the word. A scan emits the payloads of all words in order, and payloads
of neighbours are composed to the checksum of an n-gram, whose remainder is its bucket. Buckets are counted over the corpus and
over the target; a document's weight is the sum of its features' log ratios, and documents are drawn by weight plus Gumbel noise
made from a hash of their id, which is sampling without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import checksums, common

# Letters and digits of ASCII, and every byte above ASCII, belong to words; A-Z become a-z.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


class Dictionary:
    """An automaton over delimiter-bounded words."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)
        if words:
            self.automaton.make_automaton()
        self.crc = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words))
        # After a first word, a blank goes with the next: its payload is that of " word".
        self.next_crc = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))
        self.next_length = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """End of each word of the text (its delimiter's place), and its number, in order."""
        if not len(self.crc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.fromiter((x for pair in self.automaton.iter(text) for x in pair), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def features(texts: list[str], n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For sizes 1 to n: the text of each run of so many words, and its bucket. Sizes and runs come in order."""
    data = [t.encode("utf-8", "surrogatepass").translate(_BYTES) for t in texts]
    row = b" " + b" ".join(data) + b" "
    ends = np.cumsum([len(d) + 1 for d in data])  # the delimiter after each text
    known = Dictionary(sorted(set(row.split())))
    place, word = known.scan(row.decode("latin-1"))
    owner = np.searchsorted(ends, place)
    crc = known.crc[word]
    for size in range(1, n + 1):
        if size > 1:
            begin = len(word) - len(crc) + 1
            following = word[begin:]
            crc = checksums.joined(crc[:-1], known.next_crc[following], known.next_length[following])
        last = owner[size - 1 :]
        inside = last == owner[: len(last)]
        yield last[inside], (crc % np.uint32(buckets)).astype(np.int64)[inside]


def _blocks(batch: pa.RecordBatch, size: int = common.CHUNK) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, last + 1, texts): rows whose texts have about `size` code points together; a longer text comes alone."""
    texts = ["" if t is None else t for t in batch["text"].to_pylist()]
    first, total = 0, 0
    for at, text in enumerate(texts):
        if at > first and total + len(text) > size:
            yield first, at, texts[first:at]
            first, total = at, 0
        total += len(text)
    if len(texts) > first:
        yield first, len(texts), texts[first:]


def counted(texts: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """`(bucket, n)`: how many features of all texts fall into each bucket that has any. Each task adds up its own first,
    so what is shuffled is bounded by tasks times buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, held in _blocks(batch):
                for _, bucket in features(held, n, buckets):
                    sums += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used), "n": pa.array(sums[used])})

    own = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """The gain of every bucket in thousandths: `buckets` numbers, the only thing that comes to the driver."""
    source, wanted = counted(docs, n, buckets), counted(target, n, buckets)
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    rows = (
        every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(wanted.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).toPandas()
    )
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[rows["bucket"]], t[rows["bucket"]] = rows["s"], rows["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = 1) -> DataFrame:
    """`(doc_id, n_words, n_features, weight)` of every row."""
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words, found, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, last, held in _blocks(batch):
                for size, (owner, bucket) in enumerate(features(held, n, buckets), 1):
                    own = np.bincount(owner, minlength=last - first)
                    found[first:last] += own
                    if size == 1:
                        words[first:last] = own
                    np.add.at(weight, first + owner, shared.value[bucket])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_words": words, "n_features": found, "weight": weight})

    return common.texts(docs).mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def drawn(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Every row's `(doc_id, n_features, weight, score, rank)`; rank is null where the row is not drawn.

    Of the N rows with at least `least_words` words, floor(percent * N / 100) are drawn: the highest scores, ties to the
    smaller id. A null text has no words; a null id has the noise of an empty id and comes last in a tie; rows that agree in id and text
    are ranked one after the other. An empty corpus or target is all zeros. Other columns are never read.

    Ranks come from one sort: rows (five numbers each, never text) go to range partitions, are written once, and the
    rows of the partitions before are added to a row's place in its own.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = weighed(docs, gains(docs, target, n, buckets), n).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("_long")
    )
    order = [F.desc("_long"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written first: dealing out by ranges reads its input twice.
    ordered = common.staged(rows, "weights").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ordered = common.staged(ordered, "importance")
    # The id counts from a multiple of 2**33 in every partition.
    block = F.shiftright("_at", 33)
    sizes = ordered.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col("_long").cast("bigint")).alias("_of_long"))
    # One row per range partition.
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_of_long").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_n"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    taken = F.col("_long") & (rank <= F.floor(F.lit(percent) * F.col("_n") / 100))
    return ordered.withColumn("_block", block).join(F.broadcast(sizes), "_block").select("doc_id", "n_features", "weight", "score", F.when(taken, rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of `docs` with all their columns, in no order. Ids are taken as unique; a repeated id comes with every row it has once one of them is drawn."""
    ids = drawn(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_drawn"]), "left_semi")


RESAMPLING_SQL = f"""
WITH {checksums.TABLE_SQL},
words AS (
  SELECT 'd' AS kind, row, unnest(w) AS word FROM (SELECT row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)
  UNION ALL
  SELECT 'b', 0, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
numbered AS (SELECT row_number() OVER () AS row, doc_id FROM documents),
buckets AS (SELECT word, {checksums.crc_sql(checksums.utf8_sql('word'))} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc_table),
counts AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM words JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM counts, totals),
sums AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000.0 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM numbered LEFT JOIN sums USING (row)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM ranked
"""
