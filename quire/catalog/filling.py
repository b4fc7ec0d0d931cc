"""Form data (F) over fields derived from the given orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog.base import query, table
from quire.functions import formvalues as V
from quire.operators import forms
from quire.operators.forms import Calculation, FieldRule

RULES = [
    FieldRule("price", "number", 2, 0, 0, "$", least=0, most=400000),
    FieldRule("balance", "number", 2, 2, 3),
    FieldRule("share", "percent", 1, 0),
    FieldRule("when", "date", pattern="dd-mmm-yyyy"),
    FieldRule("phone", "special", special=2),
    FieldRule("code", "mask", mask="A-9999"),
    FieldRule("apostrophes", "number", 0, 4, 2),
]


def _fields(spark, folder):
    """Orders as forms: each a price, a balance, a share, a date, a phone number, a code and a rounded number."""
    o = table(spark, folder, "orders")
    key, price = F.col("o_orderkey"), F.round("o_totalprice", 2)
    money = price.cast("decimal(18,2)")
    entry = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    phone = F.lpad((key % 10_000_000_000).cast("string"), 10, "5")
    values = F.array(
        entry("price", F.when(key % 11 == 0, "twelve").otherwise(money.cast("string"))),
        entry("balance", F.when(key % 2 == 0, F.concat(F.lit("-"), money.cast("string"))).otherwise(money.cast("string"))),
        entry("share", F.concat(F.lit("0."), F.lpad((key % 1000).cast("string"), 3, "0"))),
        entry("when", F.date_format("o_orderdate", "d/M/yyyy")),
        entry("phone", F.when(key % 7 == 0, "12345").otherwise(phone)),
        entry("code", F.concat(F.when(key % 3 == 0, "7").otherwise("K"), F.lit("-"), F.lpad((key % 10000).cast("string"), 4, "0"))),
        entry("apostrophes", money.cast("string")))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.explode(values).alias("_f")).select("doc_id", "_f.*")


_SQL = """
o AS (SELECT o_orderkey AS k, round(o_totalprice, 2)::DECIMAL(18,2) AS p, o_orderdate::DATE AS d, lpad((o_orderkey % 10000000000)::VARCHAR, 10, '5') AS ph FROM orders),
g AS (SELECT *, format('{:,.2f}', p) AS us, translate(format('{:,.2f}', p), ',.', '.,') AS eu FROM o)"""


@query("F1_display_values", f"""
WITH {_SQL}
SELECT k AS doc_id, 'price' AS name, CASE WHEN k % 11 = 0 THEN 'twelve' ELSE '$' || us END AS text, false AS red FROM g
UNION ALL SELECT k, 'balance', CASE WHEN k % 2 = 0 AND p <> 0 THEN '(' || eu || ')' ELSE eu END, k % 2 = 0 AND p <> 0 FROM g
UNION ALL SELECT k, 'share', format('{{:.1f}}', ((k % 1000) / 10.0)::DOUBLE) || '%', false FROM g
UNION ALL SELECT k, 'when', strftime(d, '%d-%b-%Y'), false FROM g
UNION ALL SELECT k, 'phone', CASE WHEN k % 7 = 0 THEN '12345' ELSE '(' || ph[1:3] || ') ' || ph[4:6] || '-' || ph[7:10] END, false FROM g
UNION ALL SELECT k, 'code', CASE WHEN k % 3 = 0 THEN '7' ELSE 'K' END || '-' || lpad((k % 10000)::VARCHAR, 4, '0'), false FROM g
UNION ALL SELECT k, 'apostrophes', replace(format('{{:,}}', round(p, 0)::BIGINT), ',', ''''), false FROM g
""")
def display(spark, folder):
    return forms.display_values(_fields(spark, folder), RULES).drop("value")


_E = "The value entered does not match the format of the field: "


@query("F2_validate", f"""
WITH {_SQL}
SELECT k AS doc_id, 'price' AS name, CASE WHEN k % 11 = 0 OR p > 400000 THEN '' ELSE rtrim(rtrim(p::VARCHAR, '0'), '.') END AS stored,
       CASE WHEN k % 11 = 0 THEN '{_E}enter a number.' WHEN p > 400000 THEN 'Invalid value: must be greater than or equal to 0 and less than or equal to 400000.' ELSE '' END AS error FROM g
UNION ALL SELECT k, 'balance', CASE WHEN k % 2 = 0 THEN '-' ELSE '' END || rtrim(rtrim(p::VARCHAR, '0'), '.'), '' FROM g
UNION ALL SELECT k, 'share', rtrim(rtrim('0.' || lpad((k % 1000)::VARCHAR, 3, '0'), '0'), '.'), '' FROM g
UNION ALL SELECT k, 'when', strftime(d, '%-d/%-m/%Y'), '' FROM g
UNION ALL SELECT k, 'phone', CASE WHEN k % 7 = 0 THEN '' ELSE ph END, CASE WHEN k % 7 = 0 THEN '{_E}a phone number.' ELSE '' END FROM g
UNION ALL SELECT k, 'code', CASE WHEN k % 3 = 0 THEN '' ELSE 'K-' || lpad((k % 10000)::VARCHAR, 4, '0') END, CASE WHEN k % 3 = 0 THEN '{_E}A-9999.' ELSE '' END FROM g
UNION ALL SELECT k, 'apostrophes', rtrim(rtrim(p::VARCHAR, '0'), '.'), '' FROM g
""")
def validate(spark, folder):
    found = forms.validate(_fields(spark, folder), RULES).drop("value")
    return found.withColumns({c: F.coalesce(c, F.lit("")) for c in ("stored", "error")})


def _items(spark, folder):
    """Line items as fields item.<n>.qty, item.<n>.price and item.<n>.rate of their order."""
    li = table(spark, folder, "lineitem")
    line = F.col("l_linenumber").cast("string")
    # An order can have a line number twice: the part tells the fields apart.
    stem = F.concat(F.lit("item."), line, F.lit("_"), F.col("l_partkey"), F.lit("_"), F.col("l_suppkey"))
    entry = lambda leaf, value: F.struct(F.concat(stem, F.lit("." + leaf)).alias("name"), value.alias("value"))
    values = F.array(
        entry("qty", F.col("l_quantity").cast("int").cast("string")), entry("price", F.col("l_extendedprice").cast("decimal(18,2)").cast("string")),
        entry("rate", F.when(F.col("l_discount") == 0, "").otherwise(F.col("l_discount").cast("decimal(4,2)").cast("string"))))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.explode(values).alias("_f")).select("doc_id", "_f.*")


CALCULATIONS = [
    Calculation("total", "SUM", ("item",)), Calculation("mean", "AVG", ("item",)), Calculation("least", "MIN", ("item",)), Calculation("most", "MAX", ("item",)),
    Calculation("nothing", "SUM", ("absent",)), Calculation("unset", "MAX", ("absent",)),
]


@query("F3_calculate", """
WITH v AS (SELECT l_orderkey AS doc_id, unnest([l_quantity::DECIMAL(18,2), l_extendedprice::DECIMAL(18,2), l_discount::DECIMAL(18,2)]) AS v FROM lineitem),
a AS (SELECT doc_id, sum(v) AS s, count(*) AS n, min(v) AS lo, max(v) AS hi FROM v GROUP BY doc_id)
SELECT doc_id, unnest(['total', 'mean', 'least', 'most', 'nothing', 'unset']) AS name, round(unnest([s::DOUBLE, s::DOUBLE / n, lo::DOUBLE, hi::DOUBLE, 0, -1]), 6) AS result FROM a
""")
def calculate(spark, folder):
    found = forms.calculate(_items(spark, folder), CALCULATIONS)
    return found.select("doc_id", "name", F.round(F.coalesce(F.col("text").cast("double"), F.lit(-1.0)), 6).alias("result"))


@query("F3_product", """
SELECT l_orderkey AS doc_id, 'product' AS name, list_reduce(list(l_quantity::BIGINT::HUGEINT), lambda a, b: a * b)::DOUBLE AS result FROM lineitem GROUP BY l_orderkey
""")
def product(spark, folder):
    """The exact product of each order's quantities."""
    li = table(spark, folder, "lineitem")
    name = F.concat(F.lit("qty."), "l_linenumber", F.lit("_"), "l_partkey", F.lit("_"), "l_suppkey")
    fields = li.select(F.col("l_orderkey").alias("doc_id"), name.alias("name"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    found = forms.calculate(fields, [Calculation("product", "PRD", ("qty",))])
    return found.select("doc_id", "name", F.col("text").cast("double").alias("result"))


@query("F3_by_style", """
WITH v AS (SELECT l_orderkey AS doc_id, (l_extendedprice * 100)::BIGINT::HUGEINT AS cents FROM (SELECT l_orderkey, round(l_extendedprice, 2)::DECIMAL(18,2) AS l_extendedprice FROM lineitem)),
t AS (SELECT doc_id, sum(cents) AS cents, count(*) AS n FROM v GROUP BY 1)
SELECT doc_id, unnest(['total', 'mean']) AS name, unnest([cents::DOUBLE / 100, round(cents::DOUBLE / 100 / n, 6)]) AS result FROM t
""")
def styles(spark, folder):
    """Prices written with the separators of five styles, each field saying which."""
    li = table(spark, folder, "lineitem")
    style = ((F.col("l_partkey") + F.col("l_linenumber")) % 5).cast("int")
    name = F.concat(F.lit("price."), "l_linenumber", F.lit("_"), "l_partkey", F.lit("_"), "l_suppkey")
    fields = li.select(
        F.col("l_orderkey").alias("doc_id"), name.alias("name"), V.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2, style).alias("value"), style.alias("separator_style"))
    found = forms.calculate(fields, [Calculation("total", "SUM", ("price",)), Calculation("mean", "AVG", ("price",))])
    return found.select("doc_id", "name", F.when(F.col("name") == "mean", F.round(F.col("text").cast("double"), 6)).otherwise(F.col("text").cast("double")).alias("result"))


@query("F4_recalculate", """
WITH o AS (SELECT o_orderkey AS doc_id, round(o_totalprice, 2)::DECIMAL(18,2) AS p FROM orders)
SELECT doc_id, unnest(['net', 'double', 'sum']) AS name, unnest([round(p - 10, 2)::DOUBLE, round((p - 10) * 2, 2)::DOUBLE, round((p - 10) * 3, 2)::DOUBLE]) AS value FROM o
""")
def recalculate(spark, folder):
    """Three fields that build on each other."""
    o = table(spark, folder, "orders")
    entry = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    fields = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(
        entry("gross", F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")), entry("net", F.lit("")), entry("double", F.lit("")), entry("sum", F.lit("")))).alias("_f")).select("doc_id", "_f.*")
    rules = [Calculation("net", expression="gross - 10"), Calculation("double", expression="net * 2"), Calculation("sum", "SUM", ("net", "double"))]
    return forms.recalculate(fields, rules).withColumn("value", F.round(F.col("value").cast("double"), 2))


def _records(spark, folder):
    c = table(spark, folder, "customer")
    entry = lambda name, value, default, locked: F.struct(F.lit(name).alias("name"), value.alias("value"), default.alias("default_value"), locked.alias("read_only"))
    return c.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(
        entry("segment", F.col("c_mktsegment"), F.lit("NONE"), F.lit(False)), entry("name", F.col("c_name"), F.lit(None).cast("string"), F.col("c_custkey") % 5 == 0))).alias("_f")).select("doc_id", "_f.*")


def _incoming(spark, folder):
    o = table(spark, folder, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0, "segment").when(F.col("o_orderkey") % 5 == 0, "unheard").otherwise("name")
    return o.select(F.col("o_custkey").alias("doc_id"), name.alias("name"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))


_IMPORT = """
f AS (SELECT c_custkey AS doc_id, unnest(['segment', 'name']) AS name, unnest([c_mktsegment, c_name]) AS value, unnest([false, c_custkey % 5 = 0]) AS read_only FROM customer),
i AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'segment' WHEN o_orderkey % 5 = 0 THEN 'unheard' ELSE 'name' END AS name, o_orderpriority AS value, o_orderkey AS seq FROM orders),
l AS (SELECT doc_id, name, arg_max(value, seq) AS v FROM i GROUP BY ALL)"""


@query("F5_import_values", f"""
WITH {_IMPORT} SELECT f.doc_id, f.name, CASE WHEN l.v IS NOT NULL AND NOT read_only THEN l.v ELSE f.value END AS value, read_only FROM f LEFT JOIN l USING (doc_id, name)
""")
def imported(spark, folder):
    return forms.import_values(_records(spark, folder), _incoming(spark, folder))[0].drop("default_value")


@query("F5_import_report", f"""
WITH {_IMPORT} SELECT l.doc_id, l.name, CASE WHEN f.read_only IS NULL THEN 'unknown' WHEN f.read_only THEN 'read-only' ELSE 'changed' END AS status FROM l LEFT JOIN f USING (doc_id, name)
""")
def import_report(spark, folder):
    return forms.import_values(_records(spark, folder), _incoming(spark, folder))[1]


@query("F6_reset", """
SELECT c_custkey AS doc_id, unnest(['segment', 'name']) AS name, unnest(['NONE', c_name]) AS value FROM customer
""")
def reset(spark, folder):
    names = table(spark, folder, "part").select(F.when(F.col("p_partkey") % 2 == 0, "segment").otherwise(F.concat(F.lit("unknown."), F.col("p_partkey"))).alias("name"))
    return forms.reset(_records(spark, folder), names).select("doc_id", "name", "value")


@query("F7_derive", """
WITH s AS (SELECT l_orderkey AS doc_id, (2 * sum(l_quantity::BIGINT) * 100 + sum((l_extendedprice::DECIMAL(18,2) * 100)::BIGINT) - sum((l_discount::DECIMAL(18,2) * 100)::BIGINT))::HUGEINT AS a,
                  sum((l_discount::DECIMAL(18,2) * 100)::BIGINT)::HUGEINT AS r FROM lineitem GROUP BY 1)
SELECT doc_id, 'd' AS name, CASE WHEN r > 0 THEN ((2000 * a + r) // (2 * r))::DOUBLE / 1000 END AS result FROM s
""")
def derive(spark, folder):
    li = table(spark, folder, "lineitem")
    stem = F.concat(F.col("l_linenumber"), F.lit("_"), "l_partkey", F.lit("_"), "l_suppkey")
    entry = lambda group, value: F.struct(F.concat(F.lit(group + "."), stem).alias("name"), value.cast("decimal(18,2)").cast("string").alias("value"))
    fields = li.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(entry("qty", F.col("l_quantity")), entry("price", F.col("l_extendedprice")), entry("rate", F.col("l_discount")))).alias("_f")).select("doc_id", "_f.*")
    found = forms.derive(fields, "d", "(price + qty * 2) / rate - 1")
    return found.select("doc_id", "name", F.round("result", 3).cast("double").alias("result"))
