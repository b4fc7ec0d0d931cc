"""Personal data, and terms that give it away.

Entities are e-mail addresses, IPv4 addresses, payment cards and phone numbers. How strongly a term reveals an entity
kind is estimated from lines of the whole corpus: PMI(term; kind) = log(p(term, kind) / (p(term) p(kind))), as a share of
the kind's own information -log p(kind). Terms are judged by what their share is at least, with p(kind | term) at the
lower end of its Wilson interval: a term met once or twice says little, and no term is left unjudged for being rare. A term
surely at or above `remove` is a disclosure and goes with the entities; one at or above `generalise` is replaced by a
general word for the kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common

KINDS = ("email", "ip", "card", "phone")
MARKS = {k: f"[{k.upper()}]" for k in KINDS}
GENERAL = {"email": "contact", "ip": "address", "card": "payment", "phone": "contact"}
# Disclosing terms a task looks up at a time; more of them are looked up in further passes over the texts.
TERMS = 200_000
# Terms a task counts before it hands its counts on; they are summed after the shuffle.
COUNTED = 100_000
# Half width of the Wilson interval in standard deviations (99 %).
DEVIATIONS = 2.576

TYPES = pa.schema([("term", pa.string()), *((c, pa.int64()) for c in ("n", *KINDS))])

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that another digit precedes is the tail of one already read; this keeps long runs of digits linear.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY_DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\b[^\W\d_]{3,}\b")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: at each @ the run of name characters before it, as far as the last match, and the longest domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
        last = found.end() if found else at + 1
        at = text.find("@", last)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if k % 2 == 0 else sum(divmod(2 * n, 10))
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end, kind) sorted by start, then kind as listed."""
    found = [(a, 0, b, "email") for a, b in emails(text)] if "@" in text else []
    if ANY_DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end(), "phone"))
    return sorted(found)


def _lines(text: str, held: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds of the entities `held` as bits) of every line."""
    out, at, k = [], 0, 0
    for line in text.split("\n"):
        end, bits = at + len(line), 0
        while k < len(held) and held[k][0] <= end:
            bits |= 1 << held[k][1]
            k += 1
        out.append((at, end, bits))
        at = end + 1
    return out


def _lowers_in_place(text: str) -> bool:
    """Without the only letters whose lower case is longer, or hangs on their neighbours."""
    return "İ" not in text and "Σ" not in text


def _terms(line: str) -> set[str]:
    """Words found in the text as it stands, each lower-cased by itself: offsets stay those of the text."""
    if _lowers_in_place(line):
        return set(WORD.findall(line.lower()))
    return {w.lower() for w in WORD.findall(line)}


def _meetings(text: str) -> Iterator[tuple[int, set[str]]]:
    """Per line with entities: their kinds as bits and the terms beside them; entities' own letters are no terms."""
    held = entities(text)
    for a, b, bits in _lines(text, held) if held else ():
        if bits:
            bare, at = [], a
            for s, _, e, _ in held:
                if a <= s <= b:
                    bare.append(text[at:s])
                    at = max(at, min(e, b))
            bare.append(text[at:b])
            yield bits, _terms(" ".join(bare))


def company(docs: DataFrame) -> DataFrame:
    """`(term, n, email, ip, card, phone)`: in how many lines with a kind each term stands; the row with a null term counts
    all lines, `n` without regard to kinds. A task hands on its counts whenever they hold COUNTED terms. Staged."""
    schema = "term string, n bigint, " + ", ".join(f"{k} bigint" for k in KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, met = 0, {}

        def counts() -> pa.RecordBatch:
            rows = [(None, lines, 0, 0, 0, 0), *((t, 0, *c) for t, c in met.items())]
            return pa.RecordBatch.from_pylist([dict(zip(("term", "n", *KINDS), r)) for r in rows], TYPES)

        for batch in common.slices(batches, 100):
            for text in batch["text"].to_pylist():
                lines += text.count("\n") + 1
                for bits, terms in _meetings(text):
                    for t in (None, *terms):
                        held = met.setdefault(t, [0] * len(KINDS))
                        for kind in range(len(KINDS)):
                            held[kind] += bits >> kind & 1
            if len(met) > COUNTED:
                yield counts()
                lines, met = 0, {}
        yield counts()

    return common.staged(common.texts(docs).select("text").mapInArrow(run, schema).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", *KINDS)]), "company")


def _blocks(terms: DataFrame, columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of a table of terms, at most TERMS at a time, by ranges of a hash."""
    n = terms.count()
    parts = max(1, -(-n * 5 // (TERMS * 4)))  # a little under, as hashes are not even
    for k in range(parts):
        yield [tuple(r) for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).select(*columns).collect()] if n else []


def totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """`(term, n)`: in how many lines of the corpus each of `terms (term)` stands."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "term string, n bigint")
    for block in _blocks(terms, ["term"]):
        wanted = spark.sparkContext.broadcast(frozenset(t for t, in block))

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            names, met = wanted.value, Counter()  # a task's counts: at most TERMS of them
            for batch in common.slices(batches, 2000):
                for text in batch["text"].to_pylist():
                    if _lowers_in_place(text):
                        words = map(WORD.findall, text.lower().split("\n"))
                    else:
                        words = map(_terms, text.split("\n"))
                    met.update(chain.from_iterable(map(names.intersection, words)))
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(met), pa.string()), "n": pa.array(list(met.values()), pa.int64())})

        part = common.texts(docs).select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        out = out.unionByName(part)
    return out


def _at_least(together: Column, n: Column) -> Column:
    """The lower end of the Wilson interval of together / n."""
    z2, p = DEVIATIONS * DEVIATIONS, together / n
    spread = DEVIATIONS * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (p + z2 / (2 * n) - spread) / (1 + z2 / n)


def disclosures(docs: DataFrame, generalise: float = 0.6, remove: float = 0.8) -> DataFrame:
    """`(term, kind, share, sure, action)` of terms whose PMI with a kind is surely at least `generalise` of the kind's
    information; of several kinds the surest, then the first listed. `share` is the plain estimate. Staged."""
    met = company(docs)
    lines = met.where("term is null").agg(*[F.sum(c).alias(c) for c in ("n", *KINDS)]).first()
    every = lines["n"] or 0
    info = [(k, lines[name], -log(lines[name] / every)) for k, name in enumerate(KINDS) if 0 < (lines[name] or 0) < every]
    kinds = docs.sparkSession.createDataFrame(info, "kind int, of_kind bigint, info double")  # one row per kind
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(name).alias("together")) for k, name in enumerate(KINDS)])
    share = lambda p: F.log(p * F.lit(float(every)) / F.col("of_kind")) / F.col("info")
    pairs = met.where("term is not null").select("term", F.explode(each).alias("_m")).select("term", "_m.*").where("together > 0")
    # A term stands in at least as many lines as it stands beside a kind; no count of all its lines can make it surer.
    able = pairs.join(F.broadcast(kinds), "kind").where(share(_at_least(F.col("together"), F.col("together"))) >= generalise)
    able = common.staged(able, "able")
    rated = able.join(totals(docs, able.select("term").distinct()), "term").withColumns(
        {"share": share(F.col("together") / F.col("n")), "sure": share(_at_least(F.col("together"), F.col("n")))})
    best = rated.groupBy("term").agg(F.max_by(F.struct("kind", "share", "sure"), F.struct("sure", -F.col("kind"))).alias("b")).select("term", "b.*")
    action = F.when(F.col("sure") >= remove, "remove").otherwise("generalise")
    return common.staged(best.where(F.col("sure") >= generalise).withColumn("action", action), "disclosures")


SPANS = "doc_id bigint, text string, starts array<bigint>, ends array<bigint>, kinds array<string>, general array<string>"


def spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """`(doc_id, text, starts, ends, kinds, general)` for every row: entities, then terms as kinds `term_remove` and
    `term_generalise`, sorted by start and then as listed; `general` is what a term to generalise becomes. Terms inside an
    entity are not marked again."""
    order = {k: i for i, k in enumerate((*KINDS, "term_remove", "term_generalise"))}

    def written(batch: pa.RecordBatch, rows: list[list[tuple]]) -> pa.RecordBatch:
        column = lambda k, kind: pa.array([[f[k] for f in row] for row in rows], pa.list_(kind))
        return pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"], "text": batch["text"], "starts": column(0, pa.int64()), "ends": column(2, pa.int64()),
            "kinds": column(3, pa.string()), "general": column(4, pa.string())})

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield written(batch, [[(*found, None) for found in entities(text)] for text in batch["text"].to_pylist()])

    rows = common.texts(docs).mapInArrow(plain, SPANS)
    for block in _blocks(terms, ["term", "action", "kind"]):
        wanted = docs.sparkSession.sparkContext.broadcast({t: (f"term_{action}", GENERAL[KINDS[kind]] if action == "generalise" else None) for t, action, kind in block})

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            names = wanted.value
            for batch in common.slices(batches):
                out = []
                for text, *held in zip(*(batch[c].to_pylist() for c in ("text", "starts", "ends", "kinds", "general"))):
                    found = [(a, order[k], b, k, g) for a, b, k, g in zip(*held)]
                    if names and not names.keys().isdisjoint(_terms(text)):
                        base = [s for s in found if s[3] in MARKS]
                        begins = np.array([s[0] for s in base] or [0])
                        reach = np.maximum.accumulate(np.array([s[2] for s in base] or [0]))
                        for m in WORD.finditer(text):
                            kind, general = names.get(m[0].lower(), (None, None))
                            if kind:
                                k = int(np.searchsorted(begins, m.end() - 1, "right")) - 1
                                if k < 0 or reach[k] <= m.start():
                                    found.append((m.start(), order[kind], m.end(), kind, general))
                        found.sort(key=lambda s: s[:3])
                    out.append(found)
                yield written(batch, out)

        rows = rows.mapInArrow(run, SPANS)
    return rows


def sanitised(docs: DataFrame, generalise: float = 0.6, remove: float = 0.8) -> DataFrame:
    """`(doc_id, text)`: entities become their mark, terms to remove nothing, terms to generalise their kind's general word.

    A null or empty text becomes an empty one; the rest is as in `digest`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = []
            for text, starts, ends, kinds, general in zip(*(batch[c].to_pylist() for c in ("text", "starts", "ends", "kinds", "general"))):
                parts, at = [], 0
                for a, b, kind, word in zip(starts, ends, kinds, general):
                    if a >= at:
                        parts += [text[at:a], MARKS.get(kind) or word or ""]
                    at = max(at, b)
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array(out, pa.string())})

    return spans(docs, disclosures(docs, generalise, remove)).mapInArrow(run, "doc_id bigint, text string")


def digest(docs: DataFrame, generalise: float = 0.6, remove: float = 0.8) -> DataFrame:
    """Per row the number of entities of each kind, the SHA-256 of their list and the list of all spans.

    A null or empty text has none; rows of equal id and text are counted as often as they come; a null id is an id like
    any other; an empty table gives an empty one; other columns stay behind.
    """
    terms = disclosures(docs, generalise, remove)
    shown = lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])
    every = F.arrays_zip("kinds", "starts", "ends")
    base = F.filter(every, lambda s: s["kinds"].isin(*KINDS))

    def count(kind: str):
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")

    return spans(docs, terms).select(
        "doc_id", *map(count, KINDS), F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, shown), ",").alias("spans"))
