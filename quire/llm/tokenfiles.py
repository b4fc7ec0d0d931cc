"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents in one array. Where each document ends, and which document it is, are
two non-decreasing sequences in Elias-Fano form: the low bits of every value side by side, the high parts in unary in a
bit vector, and the place of every 256th one of it as a 32-bit number, from which `select` finds any value. This takes
about two bits and log2(universe / documents) bits a value instead of 64.

Layout, little-endian: magic `QTOKEF01`; uint64 documents, uint64 of them without id, int64 least id, uint64 ids,
uint64 bytes an id; then per sequence (ends, doc ids) uint64 n, low bits, low bytes, upper bytes, samples, and these
three arrays; then the ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import common, pieces

MAGIC = b"QTOKEF01"
SAMPLE = 256
# Ids a file holds before the next one is begun; a longer document still goes into one file.
FILE_IDS = 1 << 25
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of unsigned numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.upper, self.samples = n, low_bits, low, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        upper[ones] = 1
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(upper, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        window = self.low[first // 8 : (first + self.low_bits + 7) // 8]
        return int.from_bytes(window.tobytes(), "little") >> (first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled one onwards."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        left += int(ONES[self.upper[byte] & ((1 << at % 8) - 1)])
        while left >= (here := int(ONES[self.upper[byte]])):
            left -= here
            byte += 1
        bits = np.flatnonzero(np.unpackbits(self.upper[byte : byte + 1], bitorder="little"))
        return (byte * 8 + int(bits[left]) - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return high | low

    def parts(self) -> list[bytes]:
        arrays = [self.low.tobytes(), self.upper.tobytes(), self.samples.astype("<u4").tobytes()]
        return [struct.pack("<5Q", self.n, self.low_bits, len(arrays[0]), len(arrays[1]), len(self.samples)), *arrays]

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, low, upper, samples = struct.unpack_from("<5Q", data, at)
        at += 40
        take = lambda size, kind=np.uint8: np.frombuffer(data[at : at + size], kind)
        low_part = take(low)
        at += low
        upper_part = take(upper)
        at += upper
        sampled = take(samples * 4, "<u4")
        return cls(n, low_bits, low_part, upper_part, sampled), at + samples * 4


def file_parts(doc_ids: list[int | None], sizes: list[int], ids: list[np.ndarray]) -> list[bytes]:
    """The bytes of one file, for documents in ascending order of id, null ids first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    width = 2 if flat.dtype.itemsize == 2 else 4
    head = struct.pack("<2QqQQ", len(doc_ids), len(doc_ids) - len(known), base, len(flat), width)
    ends, names = EliasFano.of(np.cumsum(sizes)), EliasFano.of(known.astype(np.uint64) - np.uint64(base % (1 << 64)))
    return [MAGIC, head, *ends.parts(), *names.parts(), flat.astype(f"<u{width}").tobytes()]


class TokenFile:
    """A file read back: `len`, `bounds(i)` by select, `ids(i)`, `doc_id(i)`, or everything at once."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n, self.nulls, self.base, self.n_ids, width = struct.unpack_from("<2QqQQ", view, 8)
        self.ends, at = EliasFano.read(view, 48)
        self.names, at = EliasFano.read(view, at)
        self.array = np.frombuffer(view[at:], f"<u{width}")
        if len(self.array) != self.n_ids:
            raise ValueError("a token file is cut short")

    def __len__(self) -> int:
        return self.n

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        first, last = self.bounds(i)
        return self.array[first:last]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.names.select(i - self.nulls)


class Encoder:
    """The public library's ids of whole texts, with pieces met before kept by their hash.

    The kinds of characters are asked from the library's own splitter, and a text that holds one of its special
    strings goes through the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.splitter = self.library.model, self.library.pre_tokenizer
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kinds = np.full(pieces.POINTS, pieces.OTHER, np.uint8)
        self.known = np.zeros(pieces.POINTS, bool)
        # The printable character that stands for each byte in the vocabulary's file: bytes that print stand for themselves.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.kept = pieces.PieceIds(self._encode_pieces, 500_000)

    def _learn(self, points: np.ndarray) -> None:
        split = self.splitter.pre_tokenize_str
        for p in np.unique(points[~self.known[points]]).tolist():
            c = chr(p)
            if len(split("a" + c)) == 1:
                kind = pieces.LETTER
            elif len(split("a" + c + "1")) == 2:
                kind = pieces.NUMBER
            else:
                kind = pieces.SPACE if len(split(c + c + "!")) > 1 else pieces.OTHER
            self.kinds[p], self.known[p] = (pieces.SPACE if p == 32 else kind), True

    def _encode_pieces(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, shown = self.model.tokenize, self.shown
        found = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(shown))] for p in parts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for f in found for i in f), np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32, int(sizes.sum())), sizes

    def runs(self, values: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids of the next run of it), in order."""
        whole = {i for i, v in enumerate(values) if any(s in v for s in self.special)}
        plain = [v if i not in whole else "" for i, v in enumerate(values)]
        for first, last, group in common.chunks(plain):
            self._learn(pieces.points_of(group)[0])
            at, until, owner, hashes, joined = pieces.cut(group, self.kinds)
            ids, sizes = self.kept.lookup(at, until, hashes, joined)
            per = np.bincount(owner, sizes, minlength=last - first).astype(np.int64)
            ends = np.cumsum(per)
            for k in range(last - first):
                if first + k in whole:
                    yield first + k, np.array(self.library.encode(values[first + k], add_special_tokens=False).ids, ids.dtype)
                else:
                    yield first + k, ids[ends[k] - per[k] : ends[k]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> DataFrame:
    """Encode every text, add `end_id`, and write the files into `folder` in ascending doc_id order (null ids first, rows
    of one id by text). Returns the manifest, itself written there: `(part, piece, file, n_docs, n_ids)`.

    Range partitions are sorted, and each task writes its own files under names fixed by its partition, first as a
    temporary name and then by one rename, so a task that runs again replaces what it wrote. An empty table writes no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, tools = context.partitionId(), encoder(tokenizer)
        store, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder)
        store.create_dir(root, recursive=True)
        names: list[int | None] = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        piece = held = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{piece:05d}.qtok"
            passing = f"{root}/{name}.{context.taskAttemptId()}.passing"
            with store.open_output_stream(passing) as out:
                for block in file_parts(names, sizes, ids):
                    out.write(block)
            store.move(passing, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "piece": pa.array([piece], pa.int64()), "file": [name], "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([sum(sizes)], pa.int64())})

        for batch in common.slices(batches):
            doc_ids = batch["doc_id"].to_pylist()
            done = -1
            for i, run_ids in tools.runs(batch["text"].to_pylist()):
                if i != done:
                    if done >= 0:
                        ids.append(np.array([end_id], ids[-1].dtype))
                        sizes[-1] += 1
                    if held >= FILE_IDS:
                        yield flush()
                        names, sizes, ids, held, piece = [], [], [], 0, piece + 1
                    names.append(doc_ids[i])
                    sizes.append(0)
                    done = i
                ids.append(run_ids)
                sizes[-1] += len(run_ids)
                held += len(run_ids) + 1
            if done >= 0:
                ids.append(np.array([end_id], ids[-1].dtype))
                sizes[-1] += 1
        if names:
            yield flush()

    ordered = common.texts(docs).repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    manifest = ordered.mapInArrow(run, "part bigint, piece bigint, file string, n_docs bigint, n_ids bigint")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What the files of `folder` hold: `(doc_id, start, n_tokens, ids_crc32)`, one row per document written.

    `start` counts the ids of all documents before it over all files; the crc is that of the ids as little-endian
    unsigned 32-bit integers. Only files the manifest names count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["file"].to_pylist(), batch["content"]):
                data = TokenFile(content.as_buffer())
                ends = data.ends.all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                wide = data.array.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                known = (data.names.all() + np.uint64(data.base % (1 << 64))).astype(np.int64).tolist()
                yield pa.RecordBatch.from_pydict({
                    "file": [name] * len(data), "doc_id": pa.array([None] * data.nulls + known, pa.int64()),
                    "at": starts, "n_tokens": ends - starts, "ids_crc32": pa.array(crc, pa.int64()),
                })

    manifest = spark.read.schema("part bigint, piece bigint, file string, n_docs bigint, n_ids bigint").parquet(f"{folder}/manifest")
    # One row per file: prefix sums over them are the only ordered step.
    before = W.orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.qtok").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))
    rows = files.mapInArrow(run, "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(bases, "file").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write every text's ids to files in a fresh shared folder and read them back. An empty or null text is `end_id` alone;
    repeated rows are written as often as they come; an empty table gives an empty result; other columns stay behind."""
    spark = docs.sparkSession
    folder = common.new_folder(spark, "tokens")
    if write(docs, tokenizer, folder, end_id).isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read(spark, folder)
