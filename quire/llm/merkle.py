"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Two line feeds end a section, one ends a paragraph, and a paragraph is a row of leaves: runs of at most 160 characters
up to the end of a sentence. Every node is the SHA-256 of its children's. The fingerprint writes the tree out as

    root(64 hex digits) then, for each section, /hash(16) and for each of its paragraphs ,hash(16) and for each leaf .hash(12)

so equal roots mean equal texts, and where two trees differ is found by going down only branches that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAF = r"[^.!?]{1,160}[.!?]*|[.!?]+"
LEAST_ID = -(1 << 63)


def fingerprint(text: Column) -> Column:
    """The tree of a text as a string; a null text is the empty text (one section of one empty paragraph)."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda leaf: F.sha2(leaf, 256))
        return F.struct(F.sha2(F.concat(F.lit("p"), F.array_join(leaves, "")), 256).alias("hash"), leaves.alias("leaves"))

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n", -1), paragraph)

    def section_hash(pars: Column) -> Column:
        return F.sha2(F.concat(F.lit("s"), F.array_join(F.transform(pars, lambda p: p["hash"]), "")), 256)

    def shown(s: Column) -> Column:
        pars = F.transform(s["pars"], lambda p: F.concat(F.lit(","), F.substring(p["hash"], 1, 16), F.array_join(F.transform(p["leaves"], lambda h: F.concat(F.lit("."), F.substring(h, 1, 12))), "")))
        return F.concat(F.lit("/"), F.substring(s["hash"], 1, 16), F.array_join(pars, ""))

    def whole(sections: Column) -> Column:
        root = F.sha2(F.concat(F.lit("d"), F.array_join(F.transform(sections, lambda s: s["hash"]), "")), 256)
        return F.concat(root, F.array_join(F.transform(sections, shown), ""))

    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section)
    hashed = F.transform(split, lambda pars: F.struct(section_hash(pars).alias("hash"), pars.alias("pars")))
    # Through an array of one, so the tree is worked out once and used for both root and branches.
    return F.transform(F.array(hashed), whole)[0]


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else twice the distinct leaves that two fingerprints share over the sum of their numbers."""
    leaves = [F.array_distinct(F.regexp_extract_all(f, F.lit(r"\.([0-9a-f]{12})"), F.lit(1))) for f in (a, b)]

    def dice(pair: Column) -> Column:
        total = F.size(pair["a"]) + F.size(pair["b"])
        return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(pair["a"], pair["b"])) / total)

    shared = F.transform(F.array(F.struct(leaves[0].alias("a"), leaves[1].alias("b"))), dice)[0]
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(shared)


def changes(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: an array of (section, paragraph), both from 0, of branches that are not the same at
    the same place or that only one of them has. Equal sections are not looked into."""
    def inside(at: Column, x: Column, y: Column) -> Column:
        left, right = F.split(x, ","), F.split(y, ",")
        places = F.sequence(F.lit(1), F.greatest(F.size(left), F.size(right), F.lit(2)) - 1)
        differs = F.filter(places, lambda j: ~F.get(left, j).eqNullSafe(F.get(right, j)))
        return F.transform(differs, lambda j: F.struct(at.cast("bigint").alias("section"), (j - 1).cast("bigint").alias("paragraph")))

    def each(i: Column) -> Column:
        x, y = F.get(F.split(a, "/"), i), F.get(F.split(b, "/"), i)
        nothing = F.filter(inside(i, F.lit(""), F.lit("")), lambda _: F.lit(False))
        return F.when(x.eqNullSafe(y), nothing).otherwise(inside(i - 1, F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(a, "/")), F.size(F.split(b, "/")), F.lit(2)) - 1), each))


def _block(bounds: list[int]) -> Column:
    """The number of the last bound that is not above `_id`, by halving."""
    table = F.lit(bounds)
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))
    ends = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = (at["hi"] - at["lo"] > 1) & (F.get(table, middle) <= F.col("_id"))
        left = (at["hi"] - at["lo"] > 1) & ~right
        return F.struct(F.when(right, middle).otherwise(at["lo"]).alias("lo"), F.when(left, middle).otherwise(at["hi"]).alias("hi"))

    return F.aggregate(steps, ends, halve, lambda at: at["lo"])


def with_next(docs: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """`(doc_id, text, ...)` with `next_text`, that of the following row by (doc_id, text), after the last the first's; and
    for each name in `more` (columns over `text`) also `next_<name>`.

    The table is cut into blocks at quantiles of doc_id; the rows at the head of a block are also sent to the block
    before it, so every block knows what follows its last row and the text is shuffled once. As many bounds as four
    times the shuffle partitions come to the driver. Null ids come first.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LEAST_ID)).alias("_id"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.min("_id"), F.percentile_approx("_id", [k / n for k in range(1, n)], 100_000)).first()
    bounds = sorted({found[0], *found[1]}) if found[0] is not None else [0]
    blocks = rows.withColumn("_block", _block(bounds))
    head = F.col("_id") == F.get(F.lit(bounds), F.col("_block"))
    before = F.when(F.col("_block") == 0, len(bounds) - 1).otherwise(F.col("_block") - 1)
    own = F.struct(F.col("_block").alias("b"), F.lit(False).alias("g"))
    copies = F.when(head, F.array(own, F.struct(before.alias("b"), F.lit(True).alias("g")))).otherwise(F.array(own))
    spread = blocks.select("doc_id", "text", "_id", F.explode(copies).alias("_at")).select("doc_id", "text", "_id", "_at.*")
    order = W.partitionBy("b").orderBy("g", "_id", "text")
    out = spread.withColumn("next_text", F.lead("text").over(order))
    for name, column in (more or {}).items():
        out = out.withColumn(name, column).withColumn(f"next_{name}", F.lead(name).over(order))
    return out.where(~F.col("g")).drop("_id", "b", "g")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text (its last quarter replaced by the beginning of the next document)
    and how alike they are, with the number of paragraphs where the edited tree differs. A null or empty text has the
    empty text's fingerprint; a table of one row is its own next; repeated rows are rows; other columns stay behind.
    """
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = with_next(docs, {"fingerprint": fingerprint(F.col("text"))})
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    # One element each, so that the edited text and its tree are worked out once.
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "fingerprint", "next_fingerprint", F.explode(F.array(edited)).alias("_edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256)).withColumn("edited_fingerprint", F.explode(F.array(fingerprint(F.col("_edited")))))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.size(changes(F.col("fingerprint"), F.col("edited_fingerprint"))).cast("bigint").alias("n_changed"),
    )


def _tree_sql(text: str) -> str:
    split = f"list_transform(string_split(coalesce({text}, ''), chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda l: sha256(l))))"
    return split


FINGERPRINTS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id NULLS FIRST, text),
             first_value(coalesce(text, '')) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_text,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k FROM documents),
e AS (SELECT k, doc_id, text, next_text, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM d),
t AS (SELECT k, 'a' AS which, text AS x FROM e UNION ALL SELECT k, 'b', edited FROM e UNION ALL SELECT k, 'c', next_text FROM e),
leaves AS (SELECT k, which, {_tree_sql('x')} AS tree FROM t),
pars AS (SELECT k, which, list_transform(tree, lambda s: list_transform(s, lambda p: {{'hash': sha256('p' || array_to_string(p, '')), 'leaves': p}})) AS tree FROM leaves),
secs AS (SELECT k, which, list_transform(tree, lambda s: {{'hash': sha256('s' || array_to_string(list_transform(s, lambda p: p.hash), '')), 'pars': s}}) AS tree FROM pars),
prints AS (SELECT k, which, sha256('d' || array_to_string(list_transform(tree, lambda s: s.hash), '')) || array_to_string(list_transform(tree,
    lambda s: '/' || left(s.hash, 16) || array_to_string(list_transform(s.pars, lambda p: ',' || left(p.hash, 16) || array_to_string(list_transform(p.leaves, lambda h: '.' || left(h, 12)), '')), '')), '') AS f FROM secs),
wide AS (SELECT e.k, doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, a.f AS fa, b.f AS fb, c.f AS fc,
    list_distinct(regexp_extract_all(a.f, '\\.([0-9a-f]{{12}})', 1)) AS la, list_distinct(regexp_extract_all(b.f, '\\.([0-9a-f]{{12}})', 1)) AS lb,
    list_distinct(regexp_extract_all(c.f, '\\.([0-9a-f]{{12}})', 1)) AS lc
    FROM e JOIN prints a ON a.k = e.k AND a.which = 'a' JOIN prints b ON b.k = e.k AND b.which = 'b' JOIN prints c ON c.k = e.k AND c.which = 'c'),
branches AS (SELECT k, which, s.i AS sec, p.i AS par, p.b FROM (
      SELECT k, which, unnest(list_transform(range(2, len(string_split(f, '/')) + 1), lambda i: {{'i': i, 'b': string_split(f, '/')[i]}})) AS s FROM prints WHERE which <> 'c') q,
      LATERAL (SELECT unnest(list_transform(range(2, len(string_split(q.s.b, ',')) + 1), lambda i: {{'i': i, 'b': string_split(q.s.b, ',')[i]}})) AS p)),
moved AS (SELECT k, count(*) AS n FROM (SELECT coalesce(x.k, y.k) AS k FROM (SELECT * FROM branches WHERE which = 'a') x
    FULL JOIN (SELECT * FROM branches WHERE which = 'b') y ON x.k = y.k AND x.sec = y.sec AND x.par = y.par WHERE x.b IS DISTINCT FROM y.b) GROUP BY k)
SELECT doc_id, n_chars, edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  CASE WHEN left(fa, 64) = left(fb, 64) THEN 1.0 WHEN len(la) + len(lb) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(la, lb)) / (len(la) + len(lb)) END::DOUBLE AS near_edited,
  CASE WHEN left(fa, 64) = left(fc, 64) THEN 1.0 WHEN len(la) + len(lc) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(la, lc)) / (len(la) + len(lc)) END::DOUBLE AS near_next,
  coalesce(moved.n, 0)::BIGINT AS n_changed
FROM wide LEFT JOIN moved USING (k)
"""
