"""Near copies against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from quire.llm import paritysketch
from quire.llm.components import components


def sets_of(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    names = {i: sets_of(t) for i, t in rows}
    root = {i: i for i in names}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(names), 2):
        x, y = names[a], names[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(names[i]), find(i)) for i in names}


def corpus(seed, n=160):
    some = random.Random(seed)
    word = lambda: "".join(some.choice("abcde") for _ in range(some.randint(1, 3)))
    rows = []
    for _ in range(n):
        if rows and some.random() < 0.7:
            words = some.choice(rows).split()
            for _ in range(some.randint(0, max(1, len(words) // 30))):
                at = some.randrange(len(words) + 1)
                words[at : at + some.randint(0, 1)] = [word()] * some.randint(0, 1)
        else:
            words = [word() for _ in range(some.choice([1, 3, 5, 6, 7, 8, 9, 10, 12, 20, 40, 120, 400]))]
        rows.append(some.choice([" ", "\n", "\t"]).join(words))
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    got = {r[0]: (r[1], r[2]) for r in paritysketch.grouped(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_linked_sets_share_a_signature():
    some = np.random.default_rng(4)
    for n in [5, 6, 7, 8, 9, 10, 12, 17, 18, 30, 46, 60, 200, 900]:
        for _ in range(60):
            a = np.unique(some.integers(0, 2**63, n, dtype=np.uint64))
            gone = some.integers(0, len(a) // 9 + 1)
            new = some.integers(0, 2**63, some.integers(0, len(a) // 9 + 1), dtype=np.uint64)
            b = np.unique(np.concatenate([some.permutation(a)[gone:], new]))
            common = len(np.intersect1d(a, b))
            if common * 100 >= 80 * (len(a) + len(b) - common) and (len(a) != common or len(b) != common):
                assert len(np.intersect1d(paritysketch.signatures(a), paritysketch.signatures(b)))


def test_sketch_bounds_the_difference():
    some = np.random.default_rng(5)
    a, b = some.integers(0, 2**63, 300, dtype=np.uint64), some.integers(0, 2**63, 40, dtype=np.uint64)
    x, y = paritysketch.sketch(a), paritysketch.sketch(np.concatenate([a[20:], b]))
    assert sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x, y)) <= 60


def test_long_chain(spark):
    n = 300
    order = random.Random(6).sample(range(n), n)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")
    assert {r["root"] for r in components(links).collect()} == {0}


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base + " more"), (9, base), (7, "something else entirely is here"), (8, None)]
    kept = paritysketch.representatives(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8]
