"""Rule profiles over facts, capped findings and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans import sizes

# ---- fixed values: built-in profiles as (rule, measure, comparator, threshold, at_least, severity, unit) --------
RULE_SCHEMA = "rule string, measure string, op string, threshold double, at_least double, severity string, unit string"
DIGITAL_PRINTING = [
    ("PP-0.1", "unreadable", "ge", 1.0, None, "Error", None),
    ("PP-1.1", "font_not_embedded", "ge", 1.0, None, "Error", None),
    ("PP-1.2", "font_not_embedded_invisible", "ge", 1.0, None, "Info", None),
    ("PP-2.1", "image_ppi", "lt", 150.0, None, "Error", "ppi"),
    ("PP-2.2", "image_ppi", "lt", 300.0, 150.0, "Warning", "ppi"),
    ("PP-3.1", "rgb_content", "ge", 1.0, None, "Warning", None),
    ("PP-3.3", "spot_color", "ge", 1.0, None, "Info", None),
    ("PP-4.1", "total_ink", "gt", 300.05, None, "Warning", "%"),
    ("PP-5.1", "line_width", "lt", 0.25, None, "Warning", "pt"),
    ("PP-6.1", "transparency", "ge", 1.0, None, "Info", None),
    ("PP-6.2", "transparency_group", "ge", 1.0, None, "Info", None),
    ("PP-7.1", "trim_box", "eq", 0.0, None, "Warning", None),
    ("PP-7.2", "bleed_box", "eq", 0.0, None, "Info", None),
]
PRINT_EXCHANGE = [
    ("PP-0.1", "unreadable", "ge", 1.0, None, "Error", None),
    ("PP-1.1", "font_not_embedded", "ge", 1.0, None, "Error", None),
    ("PP-1.2", "font_not_embedded_invisible", "ge", 1.0, None, "Info", None),
    ("PP-3.1", "rgb_content", "ge", 1.0, None, "Error", None),
    ("PP-3.2", "device_independent_color", "ge", 1.0, None, "Error", None),
    ("PP-3.3", "spot_color", "ge", 1.0, None, "Info", None),
    ("PP-6.1", "transparency", "ge", 1.0, None, "Error", None),
    ("PP-6.2", "transparency_group", "ge", 1.0, None, "Info", None),
    ("PP-7.3", "trim_or_art_box", "eq", 0.0, None, "Error", None),
    ("PP-8.1", "output_intent", "eq", 0.0, None, "Error", None),
    ("PP-8.2", "encrypted", "ge", 1.0, None, "Error", None),
]
# Most serious first.
SEVERITIES = ("Error", "Warning", "Info")
PROCESS_COLORANTS = ("Cyan", "Magenta", "Yellow", "Black")
FINDINGS_PER_PAGE = 25
# -----------------------------------------------------------------------------------------------------------------


def run_profile(facts: DataFrame, profile: Sequence[tuple]) -> DataFrame:
    """Findings where a fact `(doc_id, page_no, ord, measure, value)` breaks a rule of the profile."""
    rules = sizes.rules(facts.sparkSession, profile, RULE_SCHEMA)
    v, t = F.col("value"), F.col("threshold")
    broken = (
        F.when(F.col("op") == "lt", v < t).when(F.col("op") == "le", v <= t).when(F.col("op") == "gt", v > t)
        .when(F.col("op") == "ge", v >= t).when(F.col("op") == "eq", v == t).otherwise(v != t)
    )
    hit = facts.join(rules, "measure").where(broken & (F.col("at_least").isNull() | (v >= F.col("at_least"))))
    message = F.concat(F.col("measure"), F.lit(" is "), F.call_function("format_number", F.col("value"), F.lit("0.##")), F.lit(", limit "), F.call_function("format_number", F.col("threshold"), F.lit("0.##")))
    return hit.select(
        "doc_id", "page_no", "ord", "rule", "severity", message.alias("message"), F.col("value").alias("measure"), "unit", F.lit(1).cast("long").alias("count"))


def cap_findings(findings: DataFrame, cap: int = FINDINGS_PER_PAGE) -> DataFrame:
    """The first findings of each rule on a page, and one row that counts the rest."""
    key = ["doc_id", "page_no", "rule"]
    order = W.partitionBy(*key).orderBy("ord")
    first = findings.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= cap).drop("_rn")
    rest = (
        findings.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min_by("severity", "ord").alias("severity")).where(F.col("_n") > cap)
        .select(
            "doc_id", "page_no", F.lit(None).cast("long").alias("ord"), "rule", "severity",
            F.concat(F.lit("And "), F.col("_n") - cap, F.lit(" more like this on the page.")).alias("message"),
            F.lit(None).cast("double").alias("measure"), F.lit(None).cast("string").alias("unit"), (F.col("_n") - cap).alias("count"))
    )
    return first.unionByName(rest)


def severity_rank(column: str = "severity"):
    rank = F.lit(len(SEVERITIES))
    for i, name in enumerate(SEVERITIES):
        rank = F.when(F.col(column) == name, i).otherwise(rank)
    return rank


def summarize_findings(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per rule its first finding and how often it occurs, ranked by severity and rule."""
    at = F.struct("doc_id", "page_no", F.coalesce("ord", F.lit(2**62)))
    summed = findings.groupBy(*keys, "rule").agg(
        F.min_by("severity", at).alias("severity"), F.min_by("message", at).alias("first_message"), F.sum("count").alias("count"))
    return summed.withColumn("severity_rank", severity_rank())


def report_verdict(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Findings per severity, and whether there is no error among them."""
    counted = findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s.lower() + "s") for s in SEVERITIES])
    return counted.withColumn("passed", F.col("errors") == 0)


def inventory(uses: DataFrame, process: Sequence[str] = PROCESS_COLORANTS) -> DataFrame:
    """Every colorant of a document with the pages that use it; the process ones are listed even when unused.

    One row per page, so a colorant on any number of pages stays in bounds.
    """
    used = uses.select("doc_id", "name", "page_no").distinct()
    docs = uses.select("doc_id").distinct()
    always = docs.select("doc_id", F.explode(F.array(*map(F.lit, process))).alias("name"))
    idle = always.join(used, ["doc_id", "name"], "left_anti").withColumn("page_no", F.lit(None).cast("long"))
    return used.unionByName(idle).withColumn("is_process", F.col("name").isin(*process))


def inventory_summary(listed: DataFrame) -> DataFrame:
    return listed.groupBy("doc_id", "name", "is_process").agg(
        F.count("page_no").alias("pages"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


def limit_coverage(samples: DataFrame, limit: float, keys: Sequence[str] = ("doc_id", "page_no")) -> DataFrame:
    """Where samples `(x, y, value)` pass a limit: the highest, how many, what share, and the box around them."""
    over = F.col("value") > limit
    found = samples.groupBy(*keys).agg(
        F.max("value").alias("highest"), F.count_if(over).alias("over"), F.count(F.lit(1)).alias("_n"),
        *[agg(F.when(over, F.col(c))).alias(f"{name}_{c}") for c in ("x", "y") for name, agg in (("min", F.min), ("max", F.max))])
    return found.where("over > 0").withColumn("share", F.col("over") / F.col("_n")).drop("_n")
