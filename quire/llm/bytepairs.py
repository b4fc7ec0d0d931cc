"""Byte-level BPE: encoding by merge rounds over padded matrices, and decoding.

A text is cut into pieces (`pieces.cut`). Pieces not met before are put into matrices of rows of like
length, padded at the right. In each round every row merges its leftmost pair of least rank; ranks of
pairs come from one hash table of id pairs; rows with nothing left to merge leave the matrix. A piece
that is itself a token is that token, as in the public library of these rank files.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import common, pieces

NONE = np.int32(2**31 - 1)
# Code points cut into pieces at a time.
CHUNK = 1 << 17
# Rows longer than this are merged one by one, all places of the least pair in a round.
WIDEST = 256


class Vocabulary:
    """Ranks, the pair table and the bytes of every id, from a file of `base64 rank` lines."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = pieces.Slots(max(4, len(rank).bit_length() + 2))
        self.pairs.add(self._key(np.array(left, np.int64), np.array(right, np.int64)), np.array(rank, np.int32))

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where the pair is no token or a side is padding (below 0)."""
        out = np.full(len(left), NONE, np.int32)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        found = self.pairs.find(self._key(left[real], right[real]))
        out[real] = np.where(found < 0, NONE, found)
        return out

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, one after the other; number of ids of each)."""
        raw = [p.encode("utf-8", "replace") for p in parts]
        known = np.fromiter((self.ranks.get(r, -1) for r in raw), np.int64, len(raw))
        sizes = np.where(known >= 0, 1, 0).astype(np.int64)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        todo = np.flatnonzero(known < 0)
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        # Buckets by length: 1-4, 5-8, 9-16, ... so no row is padded to more than twice its length.
        bucket = np.zeros(len(raw), np.int64)
        bucket[todo] = np.ceil(np.log2(np.maximum(lengths[todo], 4))).astype(np.int64)
        for b in np.unique(bucket[todo]):
            rows = todo[bucket[todo] == b]
            if (1 << b) > WIDEST:
                merged = [self._merge_long(self.of_byte[np.frombuffer(raw[i], np.uint8)]) for i in rows]
                counts = np.fromiter(map(len, merged), np.int64, len(rows))
                flat = np.concatenate(merged)
            else:
                flat, counts = self._merge_rows([raw[i] for i in rows], lengths[rows])
            sizes[rows] = counts
            found[int(b)] = rows, flat, counts
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        whole = np.flatnonzero(known >= 0)
        out[begin[whole]] = known[whole]
        for rows, flat, counts in found.values():
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            out[np.repeat(begin[rows], counts) + inside] = flat
        return out, sizes

    def _merge_rows(self, raw: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(raw), int(lengths.max())
        owner = np.repeat(np.arange(n), lengths)
        column = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[owner, column] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        rank = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        done = np.full((n, width + 1), -1, np.int32)
        live = np.arange(n)
        columns = np.arange(width + 1)
        while len(live):
            at = rank.argmin(axis=1)  # the first of equals, so the leftmost
            row = np.arange(len(live))
            best = rank[row, at]
            over = best == NONE
            if over.any():
                done[live[over], : ids.shape[1]] = ids[over]
                keep = ~over
                live, ids, rank, at, best = live[keep], ids[keep], rank[keep], at[keep], best[keep]
                if not len(live):
                    break
                row = np.arange(len(live))
            w = ids.shape[1]
            shift = columns[None, :w] > at[:, None]
            right = np.empty_like(ids)
            right[:, :-1], right[:, -1] = ids[:, 1:], -1
            ids = np.where(shift, right, ids)
            ids[row, at] = best
            moved = np.empty_like(rank)
            moved[:, :-1], moved[:, -1] = rank[:, 1:], NONE
            rank = np.where(shift[:, :-1], moved, rank)
            rank[row, at] = self.rank_of(best, ids[row, at + 1])
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = self.rank_of(ids[inner, at[inner] - 1], best[inner])
            used = int((ids >= 0).any(axis=0).sum())
            if used + 1 < w:  # columns that only hold padding go
                ids, rank = ids[:, : used + 1], rank[:, :used]
        counts = (done >= 0).sum(axis=1)
        return done[done >= 0], counts

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece. All places of the least pair merge from the left in one round, unless one of the pairs that
        arise ranks lower: then only the leftmost place does, which is what merging one at a time gives."""
        rank = self.rank_of(ids[:-1], ids[1:])
        while len(ids) > 1:
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            # In a run of neighbouring places every second one merges.
            first = np.concatenate([[True], np.diff(at) > 1])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            before = np.where(at > 0, ids[at - 1], -1)
            joined = np.concatenate([[False], np.diff(at) == 2])
            before = np.where(joined, best, before)
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            fresh = np.full(len(at), best, np.int32)
            if len(at) > 1 and (np.minimum(self.rank_of(before, fresh), self.rank_of(fresh, after)) < best).any():
                at = at[:1]
            ids = ids.copy()
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            place = at - np.arange(len(at))
            rank = rank[keep[1:]] if len(ids) > 1 else rank[:0]
            for spot in (place, place - 1):
                spot = spot[(spot >= 0) & (spot + 1 < len(ids))]
                rank[spot] = self.rank_of(ids[spot], ids[spot + 1])
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _kept(path: str) -> pieces.PieceIds:
    return pieces.PieceIds(vocabulary(path).encode)


def encode_texts(values: list[str], path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, ids of the next run of it) in order; an empty text gives one empty run."""
    held, kinds = _kept(path), pieces.kinds()
    for first, last, group in common.chunks(values, CHUNK):
        at, until, owner, hashes, joined = pieces.cut(group, kinds)
        ids, sizes = held.lookup(at, until, hashes, joined)
        per = np.bincount(owner, sizes, minlength=last - first).astype(np.int64)
        ends = np.cumsum(per)
        for k in range(last - first):
            yield first + k, ids[ends[k] - per[k] : ends[k]]


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode it again: `(doc_id, n_tokens, ids_sha256, decoded_sha256)`, one row per row.

    Ids are hashed as little-endian unsigned 32-bit integers, decoded bytes as they are. A null or empty text has no
    ids; both digests are then those of no bytes. Null ids, repeated rows and other columns change nothing; an empty
    table gives an empty one. `path` is the rank file, read where the tasks run. `with_ids` adds `ids array<int>`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in common.slices(batches):
            n = batch.num_rows
            count = np.zeros(n, np.int64)
            ids_hash = [hashlib.sha256() for _ in range(n)]
            text_hash = [hashlib.sha256() for _ in range(n)]
            held: list[list[np.ndarray]] = [[] for _ in range(n)]
            for i, ids in encode_texts(batch["text"].to_pylist(), path):
                count[i] += len(ids)
                ids_hash[i].update(ids.astype("<u4").tobytes())
                text_hash[i].update(words.decode(ids))
                if with_ids:
                    held[i].append(ids.astype(np.int32))
            more = {"ids": pa.array([np.concatenate(h) for h in held], pa.list_(pa.int32()))} if with_ids else {}
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n_tokens": count,
                "ids_sha256": [h.hexdigest() for h in ids_hash], "decoded_sha256": [h.hexdigest() for h in text_hash],
            } | more)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return common.texts(docs).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """`(doc_id, text)` from `(doc_id, ids)`; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in common.slices(batches):
            text = [words.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array(text, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
