"""Text units: words, linguistic units, sentences, clean text and comparison tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import arrays, patterns
from quire.plans import blocks

# ---- fixed values: typographic variants folded before comparing; the soft hyphen is dropped
FOLD_FROM = "’‘“”–—­"
FOLD_TO = "''\"\"--"
# ------------------------------------------------------------------------------------------------


def spans(df: DataFrame, pattern: str, text: str = "text", out: str = "word", places: bool = True) -> DataFrame:
    """One row per match of `pattern` with its 0-based start and length; the text column is dropped.

    Offsets come from the lengths of the matches and of the gaps between them, inside the row. They cost most of the time:
    without `places` there is neither start nor length.
    """
    kept = [c for c in df.columns if c != text]
    if not places:
        return df.select(*kept, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("ord", out))
    staged = df.select(
        *kept,
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_hits"),
        F.split(text, pattern, -1).alias("_gaps"),
    )
    staged = staged.withColumn("_gap", F.transform(F.expr("slice(_gaps, 1, size(_hits))"), lambda g: F.length(g)))
    staged = staged.withColumn("_step", F.zip_with("_gap", "_hits", lambda g, h: g + F.length(h)))
    staged = staged.withColumn("_start", F.zip_with(arrays.exclusive_prefix(F.col("_step")), "_gap", lambda p, g: p + g))
    rows = staged.select(*kept, F.posexplode(F.arrays_zip("_start", "_hits")).alias("_at", "_hit"))
    return rows.select(
        *kept, F.col("_at").alias("ord"), F.col("_hit._start").alias("start"),
        F.length("_hit._hits").alias("length"), F.col("_hit._hits").alias(out),
    )


def words(lines: DataFrame, places: bool = True) -> DataFrame:
    """Maximal runs without white space or control characters."""
    return spans(lines, patterns.WORD_RUN, places=places)


def word_units(texts: DataFrame, places: bool = True) -> DataFrame:
    """Words as a reader sees them: don't and 3.14 whole, punctuation runs and ideographs on their own."""
    return spans(texts, patterns.UNIT, out="unit", places=places)


def sentences(texts: DataFrame, text: str = "text") -> DataFrame:
    """Sentences in order, without the white space between them."""
    kept = [c for c in texts.columns if c != text]
    marked = F.regexp_replace(text, patterns.SENTENCE_END, "$0\u0001")
    trimmed = F.transform(F.split(marked, "\u0001", -1), lambda s: F.regexp_replace(s, rf"\A[{patterns.SPACES}]+|[{patterns.SPACES}]+\z", ""))
    found = F.filter(trimmed, lambda s: s != "")
    rows = texts.select(*kept, F.posexplode(found).alias("_at", "sentence"))
    return rows.select(*kept, (F.col("_at") + 1).alias("sentence_no"), "sentence")


def _joined(text: str | Column) -> Column:
    return F.regexp_replace(text, rf"[-\x{{00AD}}](?:\r?\n)+(?=[{patterns.LETTERS}])", "")


def reflow(text: Column) -> Column:
    """Lines trimmed, blank ones dropped, the rest joined by one space."""
    edge = rf"\A[{patterns.SPACES}]+|[{patterns.SPACES}]+\z"
    parts = F.transform(F.split(text, "\r?\n", -1), lambda line: F.regexp_replace(line, edge, ""))
    return F.array_join(F.filter(parts, lambda line: line != ""), " ")


def clean_text(documents: DataFrame) -> DataFrame:
    """Words broken over lines joined and lines reflowed, with how many of each there were."""
    breaks = F.length("text") - F.length(F.translate("text", "\n", ""))
    staged = documents.withColumn("_joined", _joined("text"))
    left = F.length("_joined") - F.length(F.translate("_joined", "\n", ""))
    return staged.select(
        *[c for c in documents.columns if c != "text"],
        reflow(F.col("_joined")).alias("text"),
        F.regexp_count("text", F.lit(rf"[-\x{{00AD}}](?:\r?\n)+(?=[{patterns.LETTERS}])")).cast("long").alias("joins"),
        (breaks - left).cast("long").alias("_gone"),
        left.cast("long").alias("line_breaks"),
    ).drop("_gone")


def clean_counts(cleaned: DataFrame, key: str = "source") -> DataFrame:
    """Joined words and removed line breaks per source."""
    return cleaned.groupBy(key).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("joins").alias("joins"), F.sum("line_breaks").alias("line_breaks")
    )


def fold(token: str | Column) -> Column:
    """A token with curly quotes, dashes and soft hyphens made plain."""
    return F.trim(F.translate(token, FOLD_FROM, FOLD_TO))


def compare_tokens(words_: DataFrame, boxes: bool = True) -> DataFrame:
    """Words split into letter-and-digit runs and other runs, each with its share of the word's box.

    The runs of a word touch, so a run starts where the ones before it end.
    """
    kept = [c for c in words_.columns if c not in ("word", "length", "x", "w", "start", "ord")]
    base = words_.select(
        *kept, *(["x", "w"] if boxes else []), F.col("start").alias("_word_start"), F.col("length").alias("_word_length"), "word",
        F.regexp_extract_all("word", F.lit(patterns.COMPARE_TOKEN), F.lit(0)).alias("_runs"),
    )
    near = F.transform("_runs", lambda t, i: F.length(F.array_join(F.slice("_runs", 1, i), "")))
    far = arrays.exclusive_prefix(F.transform("_runs", lambda t: F.length(t)))
    starts = F.when(F.size("_runs") == 1, F.array(F.lit(0))).when(F.size("_runs") <= arrays.STEP, near).otherwise(far)
    parts = base.select(*[c for c in base.columns if c not in ("_runs", "word")], F.posexplode("_runs").alias("_part", "token"), starts.alias("_starts"))
    off = F.get("_starts", F.col("_part"))
    share = off / F.col("_word_length")
    extra = [(F.col("x") + F.col("w") * share).alias("x"), (F.col("w") * F.length("token") / F.col("_word_length")).alias("w")] if boxes else []
    return parts.select(
        *kept, *extra, (F.col("_word_start") + off).alias("start"), F.length("token").alias("length"), "token", fold("token").alias("folded")
    )


def number_tokens(tokens: DataFrame, width: int = 64) -> DataFrame:
    """Tokens numbered from 0 through each document, in page, line and character order."""
    cut = blocks.by_value(tokens, "page_no", width)
    numbered = blocks.scan(cut, ["doc_id"], ["page_no", "line_no", "start"], _rn=("number", None))
    return numbered.withColumn("pos", F.col("_rn") - 1).drop("_rn")


def line_tokens(lines: DataFrame, advance: float, width: int = 64) -> DataFrame:
    """The compare tokens of lines `(doc_id, page_no, line_no, text, x)` set in characters `advance` wide, numbered from 0 through each document.

    A line's tokens are counted, and the lines of a document added up in order, before any token is a row of its own: tokens are
    neither moved nor sorted. A document has one line of a page and number.
    """
    counted = lines.withColumn("_n", F.regexp_count("text", F.lit(patterns.LINE_TOKEN)).cast("long"))
    summed = blocks.scan(blocks.by_value(counted, "page_no", width), ["doc_id"], ["page_no", "line_no"], _upto=("sum", "_n"))
    found = spans(summed.withColumn("_before", F.col("_upto") - F.col("_n")).drop("_upto", "_n"), patterns.LINE_TOKEN, out="token")
    return found.withColumns({
        "folded": fold("token"), "x": F.col("x") + F.col("start") * advance, "w": F.col("length") * advance, "pos": F.col("_before") + F.col("ord"),
    }).drop("_before", "ord")


def token_lists(texts: DataFrame) -> DataFrame:
    """The compare tokens of whole texts, in order, as the list `tokens`: no token crosses a line's end, so a text's lines need not be rows."""
    return texts.select(*[c for c in texts.columns if c != "text"], F.regexp_extract_all("text", F.lit(patterns.LINE_TOKEN), F.lit(0)).alias("tokens"))
