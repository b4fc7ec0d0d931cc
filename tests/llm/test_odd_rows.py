"""Every operator over nulls, empty and long texts, repeated rows, clashing columns and an empty table."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import bytepairs, languages, linetemplates, merkle, paritysketch, phraseindex, sanitise, secretscan, tokenfiles, toxicity
from tests.llm.conftest import LONG, ROWS

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 1), (2, None, 1), (None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "plain WORDS stand"), (2, None), (3, ""), (None, "words stand here"), (4, "no such thing")], "item_id bigint, text string")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.scored(d, toxicity.train(d, labels(s), F.lit(True))),
    "merkle": lambda s, d: merkle.compared(d),
    "near": lambda s, d: paritysketch.grouped(d),
    "secrets": lambda s, d: secretscan.digest(d),
    "tokens": lambda s, d: tokenfiles.written_and_read(d, JSON),
    "bpe": lambda s, d: bytepairs.digests(d, RANKS),
    "lines": lambda s, d: linetemplates.deduplicated(d),
    "private": lambda s, d: sanitise.digest(d),
    "benchmark": lambda s, d: phraseindex.contamination(d, items(s)),
    "language": lambda s, d: languages.predicted(d, languages.train(d, F.lit(True))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    rows = OPERATORS[name](spark, odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    one = [tuple(v for k, v in r.asDict().items() if k not in ("near_next", "start")) for r in rows if r["doc_id"] == 1]
    if name != "merkle":  # there the next row differs
        assert one[0] == one[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []


def test_stages_keep_columns(spark, odd):
    assert toxicity.rejected(odd, labels(spark)).columns == odd.columns
    near = paritysketch.representatives(odd)
    assert near.columns == odd.columns and near.count() == len(ROWS)
    clean = phraseindex.clean(odd, items(spark), 3)
    assert clean.columns == odd.columns
    assert {r["doc_id"] for r in clean.collect()} == {2, 3, None, 4, 5, 6, 9_007_199_254_740_993}


def test_values(spark, odd):
    by = {(r["doc_id"], r["n_words"]): r for r in phraseindex.contamination(odd, items(spark)).collect()}
    assert by[1, 7]["n_hit"] == 3 and by[1, 7]["n_items"] == 1 and by[1, 7]["contaminated"]
    assert by[2, 0]["n_hit"] == 0 and not by[2, 0]["contaminated"]
    private = {r["doc_id"]: r for r in sanitise.digest(odd).collect()}
    assert private[None]["n_email"] == 1
    secret = [r for r in secretscan.digest(odd).collect() if r["n_assign"]]
    assert [(r["doc_id"], r["spans"]) for r in secret] == [(4, "assign:23:54")]
    near = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in paritysketch.grouped(odd).collect()}
    assert near[1, 3] == 1 and near[2, 0] == 2 and near[None, 3] is None
    lang = {r["doc_id"]: r for r in languages.predicted(odd, languages.train(odd, F.lit(True))).collect()}
    assert lang[2]["lang_pred"] == lang[3]["lang_pred"] == "und" and lang[9_007_199_254_740_993]["lang_pred"] == "und"
    kept = {r["doc_id"]: r for r in linetemplates.deduplicated(odd).collect()}
    assert kept[2]["text"] is None and kept[5]["text"] == LONG
