"""Token ids against the public libraries, files against their own round trip."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quire.llm import bytepairs, tokenfiles

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SPARK_TEXTS = "/root/testdata/sf0.001/documents.parquet"


def texts():
    some = random.Random(1)
    return [
        "", "a", "'s", "don't can't we've I'll 'sfoo ''s x's's  's", "  x", "x  \n y", "\n\n", "a   b  ", "x" * 5000, "ab" * 3000,
        "é中" * 400, " " * 3000, "1234 5678", "😀 😀😀", "\t\tx", "<|endoftext|> in a text",
        "".join(some.choice("abc de'tsr.\n1é中 ") for _ in range(20_000)), "".join(some.choice("abcdefghij") for _ in range(4_000)),
    ]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def gathered(runs, n):
    out = [[] for _ in range(n)]
    for i, ids in runs:
        out[i] += ids.tolist()
    return out


def test_merges_equal_the_library(library):
    values = texts()
    assert gathered(bytepairs.encode_texts(values, RANKS), len(values)) == [library.encode_ordinary(t) for t in values]


def test_long_texts_in_parts(library, monkeypatch):
    from quire.llm import common

    monkeypatch.setattr(common.chunks, "__defaults__", (500,))
    monkeypatch.setattr(common.parts, "__defaults__", (500,))
    values = ["Some words that go on. " * 200, "short", "x" * 3000]
    assert gathered(bytepairs.encode_texts(values, RANKS), 3) == [library.encode_ordinary(t) for t in values]


def test_encoder_equals_the_library():
    library, values = Tokenizer.from_file(JSON), texts()
    got = gathered(tokenfiles.Encoder(JSON).runs(values), len(values))
    assert got == [library.encode(t, add_special_tokens=False).ids for t in values]


def test_decoding_gives_the_text_back(spark):
    docs = spark.read.parquet(SPARK_TEXTS)
    ids = bytepairs.digests(docs, RANKS, with_ids=True)
    back = {r["doc_id"]: r["text"] for r in bytepairs.decoded(ids, RANKS).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [2**63 + 5] * 3, [0] * 700 + [10**6], sorted(random.Random(2).randrange(10**12) for _ in range(3000))])
def test_elias_fano(values):
    held = tokenfiles.EliasFano.of(np.array(values, np.uint64))
    assert held.all().tolist() == values
    assert [held.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(3).integers(1, 2000, 100_000))
    assert sum(map(len, tokenfiles.EliasFano.of(ends).parts())) * 8 / len(ends) < 13


def test_file_random_access():
    rows = [(None, [7, 2]), (-3, [2]), (-3, [1, 2, 3, 2]), (10**15, [9] * 500 + [2])]
    parts = tokenfiles.file_parts([r[0] for r in rows], [len(r[1]) for r in rows], [np.array(r[1], np.uint16) for r in rows])
    data = tokenfiles.TokenFile(b"".join(parts))
    assert [(data.doc_id(i), data.ids(i).tolist()) for i in range(len(data))] == rows
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(b"".join(parts)[:-2])


def test_files_hold_every_text(spark):
    library = Tokenizer.from_file(JSON)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(SPARK_TEXTS).collect()}
    start = 0
    for r in tokenfiles.written_and_read(spark.read.parquet(SPARK_TEXTS), JSON).orderBy("doc_id").collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
