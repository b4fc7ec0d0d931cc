"""Stretches of words that repeat with a period, found from Lyndon arrays.

A run is a stretch of words with smallest period q that holds at least two periods and cannot be made longer. Each run has
a period that is the longest Lyndon word at its place, under some order of the words or under its reverse. The first
phase of sorting suffixes by groups gives those lengths: groups are taken from the highest down, each place of a group lengthens the
nearest lower place before it, and the length a place has when its own group is taken is that of its longest Lyndon word.
Equal words to the right and left of each such period (longest common extensions) make it a run or not.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import checksums, common

LEAST = 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def lyndon(values: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place, by the order of the values; an end is lower than any value."""
    n = len(values)
    _, first = np.unique(values, return_inverse=True)
    group = first.tolist()
    k = int(first.max()) + 1 if n else 0
    members: list[list[int] | None] = [part.tolist() for part in np.split(np.argsort(first, kind="stable"), np.cumsum(np.bincount(first, minlength=k))[:-1])] if n else []
    context, lower, higher = [1] * k, list(range(-1, k - 1)), list(range(1, k + 1))
    left = list(range(-1, n - 1))
    taken = bytearray(n)
    length = [0] * n
    at = k - 1
    while at >= 0:
        here = [i for i in members[at] if group[i] == at]  # others have moved to a higher group since
        members[at] = None
        grown = context[at]
        for i in here:
            taken[i] = 1
            length[i] = grown
        waiting: dict[int, int] = {}
        for i in here:
            seen, j = i, left[i]
            while j >= 0 and taken[j]:
                left[seen] = left[j]
                seen, j = j, left[j]
            if j >= 0:
                waiting[j] = waiting.get(j, 0) + 1
        # Places of one group that are followed equally often by this group move together, just above the group they
        # leave; the more often, the higher.
        top: dict[int, int] = {}
        made: dict[tuple[int, int], int] = {}
        pairs = waiting.items()
        if len(here) > len(waiting):
            pairs = sorted(pairs, key=lambda pair: pair[1])
        for j, times in pairs:
            old = group[j]
            new = made.get((old, times))
            if new is None:
                under = top.get(old, old)
                new = top[old] = made[old, times] = len(context)
                over = higher[under]
                context.append(context[old] + times * grown)
                lower.append(under)
                higher.append(over)
                members.append([])
                higher[under] = lower[over] = new
            group[j] = new
            members[new].append(j)
        at = lower[at]
    return np.array(length, np.int64)


class _Extensions:
    """Longest common extensions by hashed prefixes; a hash can only make one too long, which `runs` checks."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        powers = np.full(self.n + 1, _BASE)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        mixed = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * self.powers[:-1], dtype=np.uint64)])

    def lengths(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How far the places after a and b (step 1) or before them (step -1) agree; a < b."""
        found = np.zeros(len(a), np.int64)
        shift = self.powers[b - a]
        room = self.n - b if step > 0 else a
        size = 1 << max(0, int(self.n).bit_length() - 1)
        while size:
            longer = found + size
            some = np.flatnonzero(longer <= room)
            if len(some):
                x, y, more = a[some], b[some], longer[some]
                p, q, r, s = (x, x + more, y, y + more) if step > 0 else (x - more, x, y - more, y)
                same = (self.sums[q] - self.sums[p]) * shift[some] == self.sums[s] - self.sums[r]
                found[some[same]] = more[same]
            size >>= 1
        return found


def _extended(values: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """Start and end of the stretch of period p around [i, i + p), by comparing values."""
    start, end = i, i + p
    while start > 0 and values[start - 1] == values[start - 1 + p]:
        start -= 1
    while end < len(values) and values[end] == values[end - p]:
        end += 1
    return start, end


def runs(values: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least `least` values, by start and period."""
    values = np.unique(values, return_inverse=True)[1].astype(np.int64)
    n = len(values)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    at, period = [], []
    for ordered in (values, values.max() - values):
        length = lyndon(ordered)
        place = np.arange(n)
        # A root of one value makes a run only where the value stands twice.
        use = (length > 1) | (np.append(values[1:] == values[:-1], False))
        use &= place + length < n
        at.append(place[use])
        period.append(length[use])
    i, p = np.concatenate(at), np.concatenate(period)
    ext = _Extensions(values)
    start = i - ext.lengths(i, i + p, -1)
    end = i + p + ext.lengths(i, i + p, 1)
    long = end - start >= np.maximum(least, 2 * p)
    rows = np.stack([start, end, p, i], axis=1)[long]
    if not len(rows):
        return np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    heads = np.flatnonzero(np.append(True, (np.diff(rows[:, :3], axis=0) != 0).any(axis=1)))
    kept = []
    for head, tail in zip(heads.tolist(), np.append(heads[1:], len(rows)).tolist()):
        s, e, q = rows[head, :3].tolist()
        if np.array_equal(values[s : e - q], values[s + q : e]):
            kept.append((s, e, q))
            continue
        for place in rows[head:tail, 3].tolist():  # two hashes fell together: each place by itself
            s, e = _extended(values, place, q)
            if e - s >= max(least, 2 * q):
                kept.append((s, e, q))
    return np.array(sorted(set(kept), key=lambda run: (run[0], run[2])), np.int64).reshape(-1, 3)


def _suspects(values: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Places covered by `width` values that stand again in the same text. A run of at least 2 * width values, or of two
    periods if they are longer, is covered whole: each of its places is in such a stretch one period on or back."""
    n = len(values)
    covered = np.zeros(n, bool)
    if n <= width:
        return covered
    mixed = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(31)
    last = n - width + 1
    key = owner[:last].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    for k in range(width):
        key = key * _BASE + mixed[k : k + last]
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(owner[:last] == owner[width - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(last + 1, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    for k in range(width):
        covered[k : k + last] |= again[:last]
    return covered


def _edited(ids: np.ndarray, number: int | None) -> np.ndarray:
    """Words of one text: for one id in ten, from some place on, the words there repeat."""
    n = len(ids)
    h = zlib.crc32(str(number).encode()) if number is not None else 1
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = ids.copy()
    out[a:] = ids[a + np.arange(n - a) % p]
    return out


def of_texts(texts: list[str], numbers: list[int | None] | None = None, least: int = LEAST) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """For each text its runs (start, end, period; in words) and its words; with `numbers`, after the edit of `_edited`."""
    known: dict[bytes, int] = {}
    ids, sizes = [], []
    for at, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at the six ASCII blanks only
        own = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        ids.append(_edited(own, numbers[at]) if numbers is not None else own)
        sizes.append(len(words))
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    covered = _suspects(every, owner, (least + 1) // 2)
    # Suspect stretches in one row, each followed by a value of its own, so that no run goes from one to the next.
    begins = covered & ~np.append(False, covered[:-1] & (owner[1:] == owner[:-1])[: len(covered) - 1]) if len(covered) else covered
    place = np.flatnonzero(covered)
    part = np.cumsum(begins[place]) - 1
    head = place[begins[place]]
    row = np.full(len(place) + len(head), -1, np.int64)
    where = np.arange(len(place)) + part
    row[where] = every[place]
    gap = np.flatnonzero(row < 0)
    row[gap] = len(known) + np.arange(len(gap))
    found = runs(row, least)
    base = np.concatenate([[0], np.cumsum(sizes)])
    back = np.zeros(len(row), np.int64)
    back[where] = place
    first = back[found[:, 0]]
    text_of = owner[first] if len(first) else first
    shift = first - base[text_of] - found[:, 0] if len(first) else first
    found[:, :2] += shift[:, None]
    cuts = np.searchsorted(text_of, np.arange(len(texts) + 1))
    table = list(known)
    for at in range(len(texts)):
        yield found[cuts[at] : cuts[at + 1]], [table[k] for k in ids[at].tolist()]


def _record(number: int | None, found: np.ndarray, words: list[bytes]) -> dict:
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found.tolist())
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, found[:, 0] + found[:, 2], 1)
    np.add.at(drop, found[:, 1], -1)
    dropped = np.cumsum(drop)[:-1] > 0
    kept = [w for w, d in zip(words, dropped.tolist()) if not d] if len(found) else words
    out = {
        "doc_id": number, "n_runs": len(found), "start": None, "length": None, "period": None, "exponent_milli": None,
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(),
    }
    if len(found):
        s, e, q = min(found.tolist(), key=lambda run: (run[0] - run[1], run[0], run[2]))
        out |= {"start": s, "length": e - s, "period": q, "exponent_milli": 1000 * (e - s) // q}
    return out


def _groups(batch: pa.RecordBatch, size: int = common.CHUNK) -> Iterator[tuple[list, list[str]]]:
    """Rows of a batch, whole texts together up to about `size` code points; a longer text comes alone."""
    numbers, held, total = [], [], 0
    for number, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
        if held and total + len(text) > size:
            yield numbers, held
            numbers, held, total = [], [], 0
        numbers.append(number)
        held.append(text)
        total += len(text)
    if held:
        yield numbers, held


def digests(docs: DataFrame, edited: bool = True, least: int = LEAST) -> DataFrame:
    """Per row: number of runs, the longest one (ties: the earliest, then the least period), digests of all runs and of
    the words that stay when every run keeps its first period only.

    With `edited`, one text in ten (by a checksum of its id) first has its words repeated from some place on; a null id never.
    A null or empty text has no words, no runs, and the digests of nothing. Repeated rows give equal rows; an empty table
    gives an empty one; other columns are never read. A text is worked on whole, in the task that reads it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            for numbers, texts in _groups(batch):
                rows = [_record(n, *found) for n, found in zip(numbers, of_texts(texts, numbers if edited else None, least))]
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow())

    return common.texts(docs).mapInArrow(run, _SCHEMA)


def _arrow() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in _SCHEMA.split(", "))])


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The same rows with each run cut to its first period: words that go leave with the blanks before them. Null texts
    stay null; a text without runs stays as it is, blanks included; in others words are joined by one blank."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in common.slices(batches, 100):
            texts = batch.column(at).to_pylist()
            out = []
            for text, (found, words) in zip(texts, of_texts([t or "" for t in texts], None, least)):
                drop = np.zeros(len(words) + 1, np.int64)
                np.add.at(drop, found[:, 0] + found[:, 2], 1)
                np.add.at(drop, found[:, 1], -1)
                gone = np.cumsum(drop)[:-1] > 0
                out.append(text if not len(found) else b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


# The same from equal six-word windows: distances between them, unbroken stretches of one distance, least distance of each.
RUNS_SQL = f"""
WITH {checksums.TABLE_SQL},
hashed AS (SELECT doc_id, {checksums.crc_sql(checksums.ascii_sql('doc_id::VARCHAR'))} AS h FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
plain AS (SELECT row_number() OVER () AS row, d.doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents d LEFT JOIN hashed USING (doc_id)),
placed AS (SELECT *, length(w) AS n, h % 10 = 0 AND length(w) > 0 AS cut, CASE WHEN length(w) > 0 THEN (h // 10) % length(w) END AS a, h // 10 AS g FROM plain),
edited AS (SELECT row, doc_id, n, CASE WHEN cut THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
    ELSE w[(a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1)::BIGINT] END) ELSE w END AS w FROM placed),
grams AS (SELECT row, i, array_to_string(w[i + 1 : i + 6], ' ') AS gram FROM edited, unnest(range(n - 5)) AS x(i) WHERE n >= 12),
pairs AS (SELECT x.row, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.row = y.row AND x.gram = y.gram AND x.i < y.i),
islands AS (SELECT row, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs) GROUP BY row, q, island),
runs AS (SELECT row, s, e, min(q) AS q FROM islands WHERE e - s >= greatest(12, 2 * q) GROUP BY row, s, e),
dropped AS (SELECT row, list(DISTINCT k) AS gone FROM runs, unnest(range(s + q, e)) AS x(k) GROUP BY row),
listed AS (SELECT row, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS text, arg_min({{'s': s, 'l': e - s, 'q': q}}, (s - e, s, q)) AS r FROM runs GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.s AS start, r.l AS length, r.q AS period, 1000 * r.l // r.q AS exponent_milli, sha256(coalesce(text, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM edited LEFT JOIN listed USING (row) LEFT JOIN dropped USING (row)
"""
