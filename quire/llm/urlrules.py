"""URL filters: listed rules by host and path, and association rules mined from labelled URLs.

A URL is the set of its tokens: the labels of its host, the segments of its path (numbers as one token) and the names of its
query. FP-growth finds token sets that stand together in labelled URLs often enough, and among them those that go
with a label surely enough. Rules are indexed under their rarest token; a URL looks up its own tokens and the rest of
each rule found is checked. Only DataFrame functions and the engine's own FP-growth are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common

ALLOW, BLOCK = "allow", "block"
# Tokens begin with what they are, so a label is no URL token.
_LABEL = "label="


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z as a-z. Empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted: `host:` labels, `path:` segments (digits in them as `0`), `query:` names."""
    host = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host:"), x))
    segment = lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0"))
    path = F.transform(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), segment)
    asked = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.transform(F.filter(F.split(asked, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(host, path, query), lambda x: x != "host:")))


def listed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """`pages` with `_host`, `_path`, `_rule` and `_listed` (the rule's verdict): the longest of the `rules` `(verdict, host, path)`
    whose host is the URL's or a parent of it and whose path begins the URL's path; of two alike the blocking one.

    Each page looks up the ends of its host in the rules, so a list of any length is one join.
    """
    row = F.struct(F.col("page_id"), F.col("_host"), F.col("_path"), F.col("_url"))
    labels = F.split("_host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = rules.select(F.col("host").alias("_end"), F.struct(F.length(F.concat("host", "path")).alias("n"), (F.col("verdict") == BLOCK).alias("blocks"), F.concat("host", "path").alias("rule"), F.col("path").alias("path")).alias("_found"))
    keyed = pages.select("page_id", F.col("url").alias("_url"), host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path")).withColumn("_at", F.monotonically_increasing_id())
    met = keyed.select("*", F.explode(ends).alias("_end")).join(known, "_end", "left").select("_at", row.alias("_row"), F.when(F.startswith("_path", F.col("_found.path")), F.col("_found")).alias("_found"))
    best = met.groupBy("_at").agg(F.first("_row").alias("_row"), F.max("_found").alias("_found"))
    verdict = F.when(F.col("_found.blocks"), BLOCK).when(F.col("_found").isNotNull(), ALLOW)
    return best.select("_row.*", F.col("_found.rule").alias("_rule"), verdict.alias("_listed"))


def mined(labelled: DataFrame, support: float = 0.002, least: int = 8, confidence: float = 0.6) -> DataFrame:
    """Rules `(verdict, antecedent, confidence, n)` from `(url, blocked)`, each at least `confidence` sure and holding in at least
    `least` URLs and a share `support` of them. A rule is pruned where dropping one token of it leaves a rule of
    the same verdict that is at least as sure. Null labels and URLs without tokens teach nothing."""
    label = F.concat(F.lit(_LABEL), F.when(F.col("blocked"), BLOCK).otherwise(ALLOW))
    items = labelled.where("blocked is not null").select(tokens(F.col("url")).alias("_own"), label.alias("_label")).where(F.size("_own") > 0)
    items = common.staged(items.select(F.array_append("_own", F.col("_label")).alias("items")), "url-items")
    n = items.count()
    schema = "verdict string, antecedent array<string>, confidence double, n bigint"
    if n < least:
        return labelled.sparkSession.createDataFrame([], schema)
    wanted = max(least, -(-n * support // 1))
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Half a URL less, so that rounding up gives the number wanted.
    model = FPGrowth(itemsCol="items", minSupport=(wanted - 0.5) / n, minConfidence=confidence, numPartitions=parts).fit(items)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith(_LABEL)).select(
        F.substring(F.element_at("consequent", 1), len(_LABEL) + 1, 16).alias("verdict"), F.array_sort("antecedent").alias("antecedent"), "confidence", F.round(F.col("support") * n).cast("bigint").alias("n")
    )
    found = common.staged(found.where(~F.exists("antecedent", lambda x: x.startswith(_LABEL))), "url-rules")
    # One token less: a rule meets its parents by an equal antecedent.
    less = F.transform("antecedent", lambda x: F.array_remove("antecedent", x))
    parents = found.select("verdict", F.col("antecedent").alias("_less"), F.col("confidence").alias("_sure"))
    beaten = found.withColumn("_less", F.explode(less)).join(parents, ["verdict", "_less"]).where(F.col("_sure") >= F.col("confidence")).select("verdict", "antecedent").distinct()
    return common.staged(found.join(beaten, ["verdict", "antecedent"], "left_anti").select(schema_names(schema)), "url-pruned")


def schema_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def indexed(rules: DataFrame) -> DataFrame:
    """`(token, rest, verdict, confidence, n)`: each rule once, under the token that fewest rules hold (ties: the least), so common
    tokens have short postings."""
    rows = rules.withColumn("_id", F.xxhash64("verdict", "antecedent"))
    each = rows.select("*", F.explode("antecedent").alias("token"))
    holders = each.groupBy("token").agg(F.count(F.lit(1)).alias("_holders"))
    rarest = each.join(holders, "token").groupBy("_id", "verdict", "antecedent", "confidence", "n").agg(F.min(F.struct("_holders", "token")).alias("_key"))
    return rarest.select(F.col("_key.token").alias("token"), F.array_remove("antecedent", F.col("_key.token")).alias("rest"), "verdict", "confidence", "n")


def _strength() -> Column:
    """What decides between rules that fit: the surest, then the blocking one, then the one with most URLs behind it."""
    return F.struct("confidence", (F.col("verdict") == BLOCK).alias("blocks"), "n")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct `_url`s for which some mined rule fits, with the strongest one's `confidence` and `blocks`."""
    own = urls.select("_url").where("_url is not null").distinct().withColumn("_tokens", tokens(F.col("_url")))
    postings = indexed(rules).select("token", "rest", _strength().alias("_strength"))
    met = own.select("_url", "_tokens", F.explode("_tokens").alias("token")).join(postings, "token").where(F.size(F.array_except("rest", "_tokens")) == 0)
    best = met.groupBy("_url").agg(F.max("_strength").alias("_strength"))
    return best.select("_url", F.col("_strength.confidence").alias("confidence"), F.col("_strength.blocks").alias("blocks"))


def judged(pages: DataFrame, labels: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """`(page_id, host, path, rule, verdict, confidence)` of every row of `pages` `(page_id, url)`.

    The listed rule's verdict stands; where none fits, the strongest mined rule's; where none fits either, `allow`.
    `labels` `(url, blocked)` are what rules are mined from; repeated labels of one URL count each. A null URL and one without
    `://` have an empty host and path, no tokens, and are allowed. Repeated rows give equal rows; an empty table gives an
    empty one; other columns are never read.
    """
    known = common.staged(listed(pages.select("page_id", "url"), rules), "url-listed")
    method = matched(known.where("_listed is null"), mined(labels, **options))
    columns = [F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule")]
    # Pages that need no lookup stay out of the join, where they would all meet under one key.
    asks = F.col("_listed").isNull() & F.col("_url").isNotNull()
    told = known.where(~asks).select("page_id", *columns, F.coalesce("_listed", F.lit(ALLOW)).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    found = known.where(asks).join(method, "_url", "left").select("page_id", *columns, F.when(F.col("blocks"), BLOCK).otherwise(ALLOW).alias("verdict"), "confidence")
    return told.unionByName(found)


def rule_table(docs: DataFrame, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """`(verdict, host, path)` rules from the caller's own list."""
    return docs.sparkSession.createDataFrame(list(rows), "verdict string, host string, path string")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """`(url, blocked)` from `labels` `(doc_id, quality, toxic)`: a page's last path segment begins with the number of the document it was
    made from, and a document that is toxic or of low quality is to be blocked."""
    number = F.regexp_extract(path_of(F.col("url")), r"(?s)/([0-9]{1,18})[^/0-9]*/?$", 1)
    own = pages.select("url", F.when(number != "", number.cast("bigint")).alias("doc_id")).where("doc_id is not null")
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("blocked"))
    return own.join(bad, "doc_id").select("url", "blocked")


# Fixed values of the query.
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_AFTER = "substr(url, instr(url, '://') + 3)"

# Frequent token sets by counting every subset of every labelled URL.
JUDGED_SQL = rf"""
WITH rules(verdict, host, path) AS (VALUES {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
cut AS (SELECT row_number() OVER () AS row, page_id, url, coalesce(instr(url, '://') > 0, false) AS good, {_AFTER} AS rest FROM pages),
parts AS (SELECT row, page_id, url, CASE WHEN good THEN {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} ELSE '' END AS host,
  CASE WHEN good THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path, CASE WHEN good THEN regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) ELSE '' END AS asked FROM cut),
bags AS (SELECT *, list_sort(list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '0', 'g')),
    list_transform(list_filter(string_split(asked, '&'), lambda x: x <> ''), lambda x: 'query:' || split_part(x, '=', 1))))) AS bag FROM parts),
bad AS (SELECT doc_id, bool_or(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS blocked FROM labels GROUP BY doc_id),
taught AS (SELECT row, bag, blocked FROM bags JOIN bad ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^/0-9]*/?$', 1), '') AS BIGINT) WHERE length(bag) > 0),
subsets AS (SELECT list_filter(bag, lambda x, i: (m >> (i - 1)) % 2 = 1) AS antecedent, blocked FROM taught, unnest(range(1, (1 << length(bag))::BIGINT)) AS u(m)),
sets AS (SELECT antecedent, count(*) AS n, count(*) FILTER (blocked) AS n_block FROM subsets GROUP BY antecedent),
found AS (SELECT antecedent, blocks, own AS n, own::DOUBLE / n AS confidence FROM (
    SELECT antecedent, true AS blocks, n_block AS own, n FROM sets UNION ALL SELECT antecedent, false, n - n_block, n FROM sets)
  WHERE own >= greatest(8, ceil((SELECT count(*) FROM taught) * 0.002)) AND own::DOUBLE / n >= 0.6),
fits AS (SELECT row, arg_max({{'blocks': blocks, 'confidence': confidence}}, {{'c': confidence, 'b': blocks, 'n': f.n}}) AS best FROM bags JOIN found f ON list_has_all(bag, antecedent) GROUP BY row),
told AS (SELECT row, arg_max({{'rule': r.host || r.path, 'verdict': verdict}}, length(r.host || r.path)) AS best FROM parts p JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY row)
SELECT page_id, host, path, told.best.rule AS rule, coalesce(told.best.verdict, CASE WHEN fits.best.blocks THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN told.best.rule IS NULL THEN fits.best.confidence END AS confidence
FROM parts LEFT JOIN told USING (row) LEFT JOIN fits USING (row)
"""
