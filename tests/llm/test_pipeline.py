"""The stages of the pipeline one after the other against plain rules on planted documents, and on odd rows and no rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from quire.llm import common
from tests.llm.conftest import ROWS, SCHEMA

STAGES = dict(corpus_pipeline.STAGES)
LABELS, ITEMS = "doc_id bigint, quality int, toxic int", "item_id bigint, text string"


def prose(dice, words):
    vocabulary = ["river", "stone", "paper", "window", "garden", "letter", "music", "market", "winter", "bridge", "yellow", "silent", "narrow", "gentle", "walked", "carried", "opened", "played"]
    return " ".join(dice.choice(vocabulary) + dice.choice("abcdefgh") + dice.choice("klmnop") for _ in range(words))


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """400 documents: toxic ones, exact and near copies, one line in many, and passages of the benchmark."""
    dice = random.Random(11)
    place = tmp_path_factory.mktemp("planted")
    notice = "Reprinted by kind permission of the northern archive and its many friends"
    items = [(i, prose(dice, 14)) for i in range(4)]
    docs, kind = [], {}
    for i in range(400):
        text, kind[i] = "\n".join(prose(dice, 20) for _ in range(3)), "clean"
        if i % 8 == 0:
            text, kind[i] = text + " you " + " ".join(dice.choice(["vile", "stupid", "filthy", "worthless"]) + " " + dice.choice(["scum", "idiot", "trash"]) for _ in range(12)), "toxic"
        elif i % 20 == 1 and i > 20:
            text, kind[i] = docs[i - 18][1], "copy"
        elif i % 20 == 5 and i > 20:
            text, kind[i] = docs[i - 18][1] + " and one more thing", "near"
        elif i % 50 == 9:
            text, kind[i] = text + " " + items[i % 4][1] + " " + prose(dice, 5), "leak"
        elif i % 5 == 2:
            text, kind[i] = text + "\n" + notice, "notice"
        docs.append((i, text, "en", "s", len(text)))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 1, int(k == "toxic")) for i, k in kind.items()], LABELS).write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{place}/benchmark.parquet")
    return str(place), {d[0]: d[1] for d in docs}, kind, notice, items


def test_stages_against_plain_rules(spark, planted):
    place, texts, kind, notice, items = planted
    docs = spark.read.parquet(f"{place}/documents.parquet")
    left = dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, place), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            left = {i: t for i, t in left.items() if kind[i] != "toxic"}
        elif name == "line dedup":
            left = {i: "\n".join(line for line in t.split("\n") if not line.startswith(notice)) for i, t in left.items()}
            got = {r.doc_id: r.text.rstrip("\n") for r in docs.collect()}
            assert {i: (got.get(i), t) for i, t in left.items() if got.get(i) != t} == {} and len(got) == len(left)
            left = {r.doc_id: r.text for r in docs.collect()}
        elif name == "n-gram Jaccard join":
            root = {i: i for i in left}
            sets = {i: shingles(t) for i, t in left.items()}
            ids = sorted(left)
            for k, i in enumerate(ids):
                for j in ids[k + 1 :]:
                    if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        a, b = i, j
                        while root[a] != a:
                            a = root[a]
                        while root[b] != b:
                            b = root[b]
                        root[max(a, b)] = min(a, b)
            left = {i: t for i, t in left.items() if root[i] == i}
            assert len(left) < len(ids)
        else:
            windows = {tuple(t.lower().split()[i : i + 10]) for _, t in items for i in range(len(t.split()) - 9)}
            words = {i: t.lower().split() for i, t in left.items()}
            left = {i: t for i, t in left.items() if not any(tuple(words[i][k : k + 10]) in windows for k in range(len(words[i]) - 9))}
        assert {r.doc_id for r in docs.select("doc_id").collect()} == set(left), name
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in left.items()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, place).collect()} == want


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_odd_rows(spark, odd, planted, name):
    out = STAGES[name](spark, odd, planted[0])
    assert name == "byte-level BPE" or out.columns == odd.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert len(kept) <= len(ROWS) and (name == "n-gram Jaccard join" or len(kept) == len(ROWS))


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_no_rows(spark, empty, planted, name):
    assert STAGES[name](spark, empty, planted[0]).collect() == []


def test_run_on_no_rows(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", LABELS), ("benchmark", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.lit(True)).collect() == []
