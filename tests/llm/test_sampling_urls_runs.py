"""Importance resampling, URL filters and periodic runs against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quire.llm import checksums, importance, repeats, urlrules
from tests.llm.conftest import LONG, ROWS

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# Runs ---------------------------------------------------------------------------------------------------------------


def plain_runs(v, least):
    n, found = len(v), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and v[j] == v[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items() if e - s >= max(least, 2 * q)), key=lambda r: (r[0], r[2]))


def longest_lyndon(v, i):
    return max(j - i for j in range(i + 1, len(v) + 1) if all(v[i:j] < v[k:j] for k in range(i + 1, j)))


def strings(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        v = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        yield v if rng.random() < 0.6 else (v[: rng.randint(1, 8)] * 10)[: len(v)] + v[: rng.randint(0, 5)]


def test_lyndon_arrays():
    for v in strings(1, 300):
        assert repeats.lyndon(np.array(v, np.int64)).tolist() == [longest_lyndon(v, i) for i in range(len(v))]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_short_strings(least):
    for v in strings(least, 400):
        assert [tuple(r) for r in repeats.runs(np.array(v, np.int64), least).tolist()] == plain_runs(v, least)


def test_runs_whose_hashes_fall_together():
    # Sums of powers modulo 2**64 are equal for halves of this sequence; results must not be.
    thue = np.array([bin(i).count("1") % 2 for i in range(1 << 13)])
    assert [tuple(r) for r in repeats.runs(thue, 12).tolist()] == plain_runs(thue.tolist()[: 1 << 13], 12)


def test_runs_of_texts_stay_inside_them():
    rng = random.Random(5)
    for _ in range(60):
        texts = [" ".join(str(rng.randrange(rng.randint(1, 3))) for _ in range(rng.randint(0, 60))) for _ in range(5)]
        for text, (found, words) in zip(texts, repeats.of_texts(texts)):
            assert [tuple(r) for r in found.tolist()] == plain_runs(text.split(" ") if text else [], 12)


def plain_digest(number, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(number).encode()) if number is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, 12)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    top = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (number, len(found), *best, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_digests(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") + "\t" * rng.randint(0, 1) for _ in range(rng.randint(0, 150)))) for i in range(120)]
    rows += [(None, "x " * 30), (9, None), (20, "\u00a0a\x1c b " * 20), (10, "y " * 30), (10, "y " * 30)]
    got = repeats.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_digest(*r) for r in rows), key=str)


def test_run_digests_of_odd_rows(spark, odd, empty):
    rows = repeats.digests(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] != 4}
    nothing = hashlib.sha256(b"").hexdigest()
    assert by[2]["collapsed_sha256"] == by[3]["runs_sha256"] == nothing and by[2]["n_runs"] == 0
    assert by[5]["n_runs"] == 0 and by[5]["collapsed_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert repeats.digests(empty).collect() == []


def test_collapsed_keeps_columns(spark, odd, empty):
    out = repeats.collapsed(odd)
    assert out.columns == odd.columns and sorted(r["text"] or "" for r in out.collect()) == sorted(r[1] or "" for r in ROWS)
    again = spark.createDataFrame([("a b c " * 6 + "end",), ("a  b",)], "text string")
    assert sorted(r[0] for r in repeats.collapsed(again).collect()) == ["a  b", "a b c end"]
    assert repeats.collapsed(empty).collect() == []


# Importance ---------------------------------------------------------------------------------------------------------


def test_joined_checksums():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.choice([0, 1, 2, 7, 300, 70_000]))) for _ in range(200)]
    first, second = ([zlib.crc32(p[k]) for p in pairs] for k in (0, 1))
    got = checksums.joined(np.array(first, np.uint32), np.array(second, np.uint32), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def plain_features(text, n):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def test_features_of_three_words():
    rng = random.Random(3)
    for _ in range(100):
        texts = ["".join(rng.choice("aBcé日 \n,.0\x00\xa0İ😀-") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        parts = list(importance.features(texts, 3, 10_000))
        for at, text in enumerate(texts):
            assert [b for owner, bucket in parts for b in bucket[owner == at].tolist()] == plain_features(text, 3)[1]


def plain_draw(docs, target, n=1, percent=10, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text, n)[1])
    for text in target:
        t.update(plain_features(text, n)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    rows = []
    for number, text in docs:
        words, found = plain_features(text, n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if number is None else number}".encode()).hexdigest()[:8], 16)
        rows.append([number, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    long = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(long, 1):
        row.append(place if place <= percent * len(long) // 100 else None)
    return [(*r[:4], r[5] if len(r) > 5 else None) for r in rows]


@pytest.mark.parametrize("n", [1, 2])
def test_draw(spark, n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "it", "IT"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(300)] + [(300, None), (301, ""), (302, "one " * 500)]
    target = [" ".join(rng.choices(vocabulary[:9], k=30)) for _ in range(20)] + [None]
    got = importance.drawn(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(t,) for t in target], "text string"), n=n)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_draw(docs, target, n), key=str)


def test_draw_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([("plain WORDS stand",), (None,), ("",)], "text string")
    rows = importance.drawn(odd, items, percent=100, least_words=1).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 7
    assert {r["rank"] for r in rows if r["doc_id"] in (2, 3)} == {None}
    assert importance.drawn(empty, items).collect() == []
    assert all(r["rank"] is None for r in importance.drawn(odd, items, percent=0).collect())
    assert importance.resampled(odd, items, percent=100, least_words=1).columns == odd.columns
    assert importance.resampled(odd, items, percent=100, least_words=1).count() == 8  # both rows of id 4 come
    assert importance.drawn(odd, items.where("false")).count() == len(ROWS)


# URLs ---------------------------------------------------------------------------------------------------------------


def bag(url):
    if url is None or "://" not in url:
        return frozenset()
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    asked = re.match(r"[^?#]*\?([^#]*)", rest)
    out = {f"host:{x}" for x in host.translate(ASCII_LOWER).split(".") if x} | {"path:" + re.sub("[0-9]+", "0", x) for x in path.split("/") if x}
    return frozenset(out | {"query:" + x.split("=")[0] for x in (asked[1].split("&") if asked else []) if x})


def plain_rules(labelled, support, least, confidence):
    taught = [(bag(u), b) for u, b in labelled if b is not None and bag(u)]
    sets, blocked = Counter(), Counter()
    for own, b in taught:
        for k in range(1, len(own) + 1):
            for some in combinations(sorted(own), k):
                sets[some] += 1
                blocked[some] += b
    least = max(least, math.ceil(support * len(taught)))
    found = [(some, verdict, own / n, own) for some, n in sets.items() for verdict, own in (("block", blocked[some]), ("allow", n - blocked[some]))]
    return [r for r in found if r[3] >= least and r[2] >= confidence]


def plain_verdict(url, rules, labels):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(ASCII_LOWER)
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fits = [r for r in urlrules.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        best = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, best[1] + best[2], best[0]
    mine = [(r[2], r[1] == "block", r[3]) for r in rules if set(r[0]) <= bag(url)]
    return host, path, None, "block" if mine and max(mine)[1] else "allow"


def test_url_verdicts(spark):
    rng = random.Random(4)
    hosts = ["casino.example.org", "a.example.org", "Blog.Example.net", "www.example.com", "x.www.example.com", "example.com", "net", "unrelated.info"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/fr/', '/es/'])}{rng.choice(['', '7', 'play', '12.html'])}{rng.choice(['', '?page=2&ref=x', '#top'])}" for _ in range(250)]
    odd = [None, "", "no scheme", "://", "ftp://", "http://a.b?c/d://e", "HTTP://EXAMPLE.COM/EN/", "x://example.com/en/\nnext", "http://com", "http://com/", "http://notexample.com/en/1", "http://.net./fr/"]
    pages = [(i, u) for i, u in enumerate(urls + odd + urls[:20])]
    labelled = [(u, "casino" in u and "play" in u or rng.random() < 0.1) for u in urls] + [(None, True), ("http://a.b", None)]
    options = {"support": 0.01, "least": 4, "confidence": 0.6}
    frame = spark.createDataFrame(pages, "page_id bigint, url string").selectExpr("*", "'other' as host", "'other' as _url", "1 as rule")
    got = urlrules.judged(frame, spark.createDataFrame(labelled, "url string, blocked boolean"), urlrules.rule_table(frame, urlrules.RULES), **options)
    rules = plain_rules(labelled, **options)
    want = sorted(((i, *plain_verdict(u, rules, labelled)) for i, u in pages), key=str)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == want
    assert any(w[3] is None and w[4] == "block" for w in want)


def test_pruned_rules_decide_alike(spark):
    rows = [(f"http://bad.org/{x}/play", True) for x in "abcdef"] * 3 + [(f"http://good.org/{x}/read", False) for x in "abcdef"] * 3
    mined = urlrules.mined(spark.createDataFrame(rows, "url string, blocked boolean"), least=3)
    kept = {(r["verdict"], tuple(r["antecedent"])) for r in mined.collect()}
    assert ("block", ("host:bad",)) in kept and ("block", ("host:bad", "path:play")) not in kept
    assert len(plain_rules(rows, 0.002, 3, 0.6)) > len(kept)


def test_no_pages_and_no_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://b.com/")], "page_id bigint, url string")
    labels = spark.createDataFrame([], "url string, blocked boolean")
    table = urlrules.rule_table(pages, urlrules.RULES)
    assert sorted((tuple(r) for r in urlrules.judged(pages, labels, table).collect()), key=str) == [
        (1, "a.org", "/x", None, "allow", None), (1, "a.org", "/x", None, "allow", None), (None, "b.com", "/", "com/", "allow", None)]
    assert urlrules.judged(pages.where("false"), labels, table).collect() == []
    known = spark.createDataFrame([(7, 0, None), (7, None, None), (8, 1, 1), (None, 0, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(f"http://a.org/en/{x}",) for x in ("7", "8.html", "9/", "5", "", "x7", "99999999999999999999")] + [(None,)], "url string")
    assert {(r["url"][16:], r["blocked"]) for r in urlrules.page_labels(some, known).collect()} == {("7", True), ("8.html", True), ("9/", False)}
