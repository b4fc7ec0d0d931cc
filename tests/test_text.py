"""Text units, search and comparison on small fixtures with known answers."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import patterns
from quire.functions.myers import edit_script, gap_script
from quire.plans import chains
from quire.operators import compare, search, units
from quire.sources import documents as D


def texts(spark, *values):
    return spark.createDataFrame([(i, 1, 0, t) for i, t in enumerate(values)], "doc_id long, page_no int, line_no int, text string")


def test_word_units(spark):
    rows = units.word_units(texts(spark, "Hello, world", "It don't matter", "pi is 3.14 today", "a well-known fact", "snake_case name", "日本go"))
    found = {}
    for r in rows.orderBy("doc_id", "ord").collect():
        found.setdefault(r.doc_id, []).append(r.unit)
    assert found[0] == ["Hello", ",", "world"]
    assert "don't" in found[1] and "3.14" in found[2] and "known" in found[3] and "snake_case" in found[4]
    assert found[5] == ["日", "本", "go"]


def test_offsets_of_long_lines(spark):
    line = "  ".join("w" * (i % 5 + 1) for i in range(700))
    rows = units.words(texts(spark, line)).collect()
    assert [(r.start, r.word) for r in rows] == [(m.start(), m.group()) for m in re.finditer(r"\S+", line)]


def test_sentences(spark):
    rows = units.sentences(texts(spark, "First one. Pi is 3.14 here! Last")).orderBy("sentence_no").collect()
    assert [r.sentence for r in rows] == ["First one.", "Pi is 3.14 here!", "Last"]


def test_clean_text(spark):
    row = units.clean_text(texts(spark, "an exam-\nple  \n\n of text")).first()
    assert (row.text, row.joins) == ("an example of text", 1)


def naive_find(text, query, match_case, whole, consecutive):
    """The search rules word by word, for queries without leading or trailing spaces."""
    fold = (lambda s: s) if match_case else (lambda s: "".join(c.lower() if len(c.lower()) == 1 else c for c in s))
    t, words = fold(text), [fold(w) for w in patterns.query_words(query)]
    neighbour = lambda c: c != "" and (c.isascii() and (c.isalnum() or c in "[\\]^_`"))
    ok = lambda s, e: not whole or not (neighbour(t[s - 1:s]) or neighbour(t[e:e + 1]))
    hits, at = [], 0
    while True:
        start = t.find(words[0], at)
        if start < 0:
            return hits
        end, good = start + len(words[0]), ok(start, start + len(words[0]))
        for word in words[1:]:
            gap = re.match(r"[ \n\r ]+", t[end:])
            begin = end + (gap.end() if gap else 0)
            if not good or not gap or not t.startswith(word, begin) or not ok(begin, begin + len(word)):
                good = False
                break
            end = begin + len(word)
        if good:
            hits.append((start, end - start))
            at = start + 1 if consecutive else end
        else:
            at = start + len(words[0])


@pytest.mark.parametrize("query", ["apple", "Apple", "APPLE", "an apple", "apple tree", "le a", "app"])
@pytest.mark.parametrize("match_case,whole", itertools.product([False, True], repeat=2))
def test_find(spark, query, match_case, whole):
    body = ["Apple apple APPLE pineapple apples", "an apple, an Apple-tree", "an \n apple tree", "aan apple"]
    found = {}
    for r in search.find(texts(spark, *body), query, match_case, whole).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, text in enumerate(body):
        assert sorted(found.get(i, [])) == naive_find(text, query, match_case, whole, False)


def test_find_spaces_and_overlaps(spark):
    rows = search.find(texts(spark, "apple pineapple apple"), " apple").collect()
    assert sorted((r.start, r.length) for r in rows) == [(0, 5), (15, 6)]
    rows = search.find(texts(spark, "apple tree apple"), "apple ").collect()
    assert [(r.start, r.length) for r in rows] == [(0, 6)]
    rows = search.find(texts(spark, "aaaa"), "aa", consecutive=True).collect()
    assert sorted(r.start for r in rows) == [0, 1, 2]


def test_find_all_equals_find(spark):
    pages = texts(spark, "The quick brown fox jumps", "over the lazy\n dog near the quick brown fox", "nothing", "x y z").select("doc_id", "page_no", "text")
    queries = ["the quick brown fox", "quick brown", "x", "lazy dog near the", "z", "brown fox"]
    table = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    many = {(r.query, r.doc_id, r.start, r.length) for r in search.find_all(table, pages).collect()}
    one = {(q, r.doc_id, r.start, r.length) for q in queries for r in search.find(pages, q).collect()}
    assert many == one and one


def test_redacted_text_has_no_hits(spark):
    rows = texts(spark, "an apple, an Apple-tree", "aan apple")
    masked = search.redact_hits(rows, "an apple")
    assert search.find(masked.select("doc_id", "page_no", "line_no", "text"), "an apple").count() == 0
    assert [r.text for r in masked.orderBy("doc_id").collect()] == ["████████, ████████-tree", "a████████"]


def lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


def test_edit_scripts_are_shortest():
    dice = random.Random(3)
    for size in [0, 1, 5, 40, 400]:
        for letters in (2, 6):
            a = np.array([dice.randrange(letters) for _ in range(size)], dtype=np.int64)
            b = np.array([dice.randrange(letters) for _ in range(max(0, size - dice.randrange(3)))], dtype=np.int64)
            script = edit_script(a, b)
            kept = [(i, j) for op, i, j in script if op == "="]
            assert all(a[i] == b[j] for i, j in kept) and len(kept) == lcs(a, b)
            assert [i for op, i, _ in script if op in "=-"] == list(range(len(a)))
            assert [j for op, _, j in script if op in "=+"] == list(range(len(b)))


def whole(script, a, b):
    """The script lists every token once, in order, and keeps equal ones; how many it keeps."""
    assert [i for op, i, _ in script if op in "=-"] == list(range(len(a)))
    assert [j for op, _, j in script if op in "=+"] == list(range(len(b)))
    kept = [(i, j) for op, i, j in script if op == "="]
    assert kept == sorted(kept) and all(a[i] == b[j] for i, j in kept)
    return len(kept)


def test_gap_scripts_are_shortest():
    dice = random.Random(4)
    for letters in (1, 2, 4, 30):
        for _ in range(60):
            a, b = ([dice.randrange(letters) for _ in range(dice.randrange(70))] for _ in "ab")
            script = gap_script(a, b)
            assert whole(script, a, b) == lcs(a, b)
            assert all((x[0], y[0]) != ("+", "-") for x, y in zip(script, script[1:]))


def edited(dice, words):
    """Up to twelve edits; every tenth moves twenty tokens."""
    b = list(words)
    for _ in range(dice.randrange(13)):
        k, kind = dice.randint(0, len(b)), dice.random()
        if kind < 0.4:
            b[k : k + 1] = []
        elif kind < 0.7:
            b[k:k] = [f"w{dice.randrange(40)}"]
        elif kind < 0.9:
            b[k : k + 1] = [f"x{dice.randrange(99999)}"]
        else:
            m, moved = dice.randint(0, len(b)), b[k : k + 20]
            del b[k : k + 20]
            b[m:m] = moved
    return b


def test_anchored_scripts(spark):
    """Whole on any pairs; where text has moved or hardly differs in words, longer than the shortest by a twentieth at most."""
    dice = random.Random(2)
    left = [[f"w{dice.randrange(v)}" for _ in range(dice.randrange(150))] for v in [3, 8, 40, 400] * 20]
    pairs = [(a, edited(dice, a)) for a in left] + [([], []), (["a"], []), ([], ["a"] * 3), (["a b"] * 9, ["a b"] * 4)]
    side = lambda k: spark.createDataFrame([(i, n, w) for i, p in enumerate(pairs) for n, w in enumerate(p[k])], "pair_id long, pos long, folded string")
    found = {}
    for r in compare.diff_words(side(0), side(1), width=50).collect():  # blocks of 50 positions: pairs cross them
        found.setdefault(r.pair_id, []).append((r.op, r.i, r.j))
    edits = least = 0
    for i, (a, b) in enumerate(pairs):
        kept = whole(sorted(found.get(i, []), key=lambda s: (s[1] + s[2], s[0] != "-")), a, b)
        edits, least = edits + len(a) + len(b) - 2 * kept, least + len(a) + len(b) - 2 * lcs(a, b)
    assert least <= edits <= 1.05 * least


def test_longest_chains(spark):
    dice = random.Random(6)
    points = []
    for key in range(30):
        js = dice.sample(range(300), 60)
        points += [(key, i, j) for i, j in enumerate(sorted(js) if key % 3 == 0 else js if key % 3 == 1 else sorted(js)[20:40] + sorted(js)[:20] + sorted(js)[40:])]
    found = {}
    for r in chains.longest(spark.createDataFrame(points, "k long, i long, j long"), ["k"], 7).collect():
        found.setdefault(r.k, []).append((r.i, r.j))
    for key in range(30):
        js = [j for k, _, j in points if k == key]
        best = [1] * len(js)
        for i, j in enumerate(js):
            best[i] = 1 + max((best[h] for h in range(i) if js[h] < j), default=0)
        chain = sorted(found[key])
        assert len(chain) == max(best) and all(js[i] == j for i, j in chain) and all(x[1] < y[1] for x, y in zip(chain, chain[1:]))


def tokens(spark, *pairs):
    side = lambda k: spark.createDataFrame(
        [(i, n, w) for i, p in enumerate(pairs) for n, w in enumerate(p[k].split())], "pair_id long, pos long, token string").withColumn("folded", units.fold("token"))
    return side(0), side(1)


def test_change_runs(spark):
    a, b = tokens(
        spark, ("The payment is due within 30 days of the invoice date", "The full payment is due within 45 days of the date"),
        ("it’s a “quote” – done", "it's a \"quote\" - done"), ("Hello World", "hello world"), ("same words", "same words"))
    runs = compare.change_runs(compare.diff_words(a, b), a, b).orderBy("pair_id", "run").collect()
    assert [(r.pair_id, r.kind, r.old_text, r.new_text) for r in runs] == [
        (0, "Inserted", "", "full"), (0, "Replaced", "30", "45"), (0, "Deleted", "invoice", ""), (2, "Replaced", "Hello World", "hello world")]
    again = compare.diff_words(a, b, ignore_case=True)
    assert again.where("pair_id = 2 and op <> '='").count() == 0
    assert again.where("pair_id = 3 and op = '='").count() == 2


def test_compare_with_itself(spark):
    rows = texts(spark, "one", "two").select("doc_id", "page_no", "text")
    assert {r.status for r in compare.compare_pages(rows, rows).collect()} == {"Unchanged"}
    assert compare.fingerprint_diff(rows, rows).count() == 0


def test_text_intake(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿bom é".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe" + "wide".encode("utf-16-le"))
    (tmp_path / "c.txt").write_bytes("plain é".encode())
    (tmp_path / "d.txt").write_bytes(b"caf\xe9 \x80 \x93q\x94")
    documents, counts = D.text_intake(spark, f"{tmp_path}/*.txt")
    assert {r.path[-5:]: r.text for r in documents.collect()} == {"a.txt": "bom é", "b.txt": "wide", "c.txt": "plain é", "d.txt": "café € “q”"}
    assert counts.count() == 4
    files = D.manifest(spark, f"{tmp_path}/*.txt")
    assert files.count() == 4 and files.where(F.length("sha256") == 64).count() == 4


def test_form_feeds_start_pages(spark):
    rows = D.lines(spark.createDataFrame([(1, "a\nb\nc\fd\ne")], "doc_id long, text string"), 2, form_feed=True)
    assert [(r.page_no, r.line_no, r.text) for r in rows.orderBy("page_no", "line_no").collect()] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (3, 1, "e")]
