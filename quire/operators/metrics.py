"""Timings, coverage, summaries and regression gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans import quantiles

# ---- fixed values: resolution steps
STEPS = (72, 96, 120, 150, 180, 220, 300)
# ----------------------------------


def nearest_rank(percent: float):
    """The rank of the smallest value with at least `percent` % of the values at or below it."""
    return lambda n: F.least(F.greatest(F.ceil(F.lit(percent / 100.0) * n), F.lit(1)), n)


def summarize(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, median, nearest-rank p95 and p99, least, most and mean per key; refused values are counted.

    The median of an even count is the mean of the two middle values. Groups without a usable value have
    no figures: they must not pass a gate.
    """
    keys = list(keys)
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    good = samples.where(~bad)
    ranks = quantiles.at_ranks(good, keys, value, {
        "_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1,
        "p95": nearest_rank(95), "p99": nearest_rank(99),
    })
    sums = samples.groupBy(*keys).agg(
        F.count_if(bad).alias("refused"), F.min(F.when(~bad, F.col(value))).alias("least"),
        F.max(F.when(~bad, F.col(value))).alias("most"), F.avg(F.when(~bad, F.col(value))).alias("mean"),
    )
    return sums.join(ranks, keys, "left").select(
        *keys, F.coalesce("n", F.lit(0)).alias("count"), ((F.col("_low") + F.col("_high")) / 2).alias("median"),
        "p95", "p99", "least", "most", "mean", "refused",
    )


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first record of each key in `order`; later ones do not count."""
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")


def coverage(pages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of pages without fallback and share of page area covered; 1 when there are no pages."""
    summed = pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.size("reasons") == 0).alias("full_pages"),
        F.avg(F.greatest(F.least("fallback_area", F.lit(1.0)), F.lit(0.0))).alias("_area"),
    )
    return summed.select(
        *keys, "pages", "full_pages",
        F.when(F.col("pages") > 0, F.col("full_pages") / F.col("pages")).otherwise(1.0).alias("page_coverage"),
        F.coalesce(1 - F.col("_area"), F.lit(1.0)).alias("area_coverage"),
    )


def reason_counts(pages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pages per fallback reason, a reason counting once on a page."""
    return pages.select(*keys, F.explode(F.array_distinct("reasons")).alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("pages"))


def bucket(value: str | Column) -> Column:
    """The next resolution step at or above the value; past the last one, the nearest 50, half to even."""
    column = F.col(value) if isinstance(value, str) else value
    found = F.when(column <= STEPS[0], STEPS[0])
    for step in STEPS[1:]:
        found = found.when(column <= step, step)
    return found.otherwise((F.bround(column / 50.0, 0) * 50).cast("int"))


def bucket_counts(rows: DataFrame, value: str, page: Sequence[str] = ("doc_id", "page_no")) -> DataFrame:
    """Hits, pages and documents per bucket."""
    per_page = rows.groupBy(bucket(value).alias("bucket"), *page).agg(F.count(F.lit(1)).alias("_n"))
    per_doc = per_page.groupBy("bucket", page[0]).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_p"))
    return per_doc.groupBy("bucket").agg(F.sum("_n").alias("hits"), F.sum("_p").alias("pages"), F.count(F.lit(1)).alias("documents"))


def corpus_summary(records: DataFrame) -> DataFrame:
    """One row of totals over file records `(opened, other_opened, typed_error, pages, classified, full_pages, area)`."""
    total = records.agg(
        F.count(F.lit(1)).alias("files"), F.count_if("other_opened").alias("other_opened"), F.count_if("opened").alias("opened"),
        F.count_if(~F.col("opened") & F.col("other_opened")).alias("failed_where_other_opened"),
        F.count_if(~F.col("opened") & ~F.col("typed_error")).alias("untyped_errors"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("classified"), F.lit(0)).alias("_c"),
        F.coalesce(F.sum("full_pages"), F.lit(0)).alias("_f"), F.sum("area").alias("_a"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(1.0)
    return total.select(
        "files", "other_opened", "opened", "failed_where_other_opened", "untyped_errors", "pages",
        ratio("_c", "pages").alias("classified_ratio"), ratio("_f", "_c").alias("full_ratio"), ratio("_a", "_c").alias("area_ratio"),
    )


def top_reasons(rows: DataFrame, reason: str, n: int = 25) -> DataFrame:
    """The most frequent reasons."""
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), reason).limit(n)


def worst(rows: DataFrame, measure: str, ties: Sequence[str], n: int = 15) -> DataFrame:
    """The rows with the largest measure."""
    return rows.orderBy(F.desc(measure), *ties).limit(n)


def gate(baseline: DataFrame, current: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Measures `(measure, value)` against their baseline under rules `(measure, rule, relative, absolute)`.

    at_most_limit: at most baseline·(1+relative)+absolute. at_least, at_most: no worse than the baseline.
    ratio: no more than `absolute` below it. A measure without a baseline is only reported.
    """
    both = baseline.withColumnRenamed("value", "baseline").join(current.withColumnRenamed("value", "current"), "measure", "full_outer").join(tolerances, "measure", "left")
    b, c = F.col("baseline"), F.col("current")
    limit = (
        F.when(F.col("rule") == "at_most_limit", b * (1 + F.col("relative")) + F.col("absolute"))
        .when(F.col("rule") == "ratio", b - F.col("absolute")).otherwise(b)
    )
    worse = F.when(F.col("rule").isin("at_most_limit", "at_most"), c > F.col("limit")).otherwise(c < F.col("limit"))
    verdict = (
        F.when(b.isNull(), "new").when(c.isNull(), "missing").when(F.col("rule").isNull(), "reported")
        .when(worse, "failed").when(b == c, "same").otherwise("passed")
    )
    change = F.when((b == 0) | b.isNull() | c.isNull(), 0.0).otherwise((c - b) / b)
    return both.withColumn("limit", limit).select("measure", "baseline", "current", "limit", change.alias("change"), verdict.alias("verdict"))


def new_reasons(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Reasons that grew or appeared `(reason, pages)`: reported, not failed."""
    both = current.join(baseline.withColumnRenamed("pages", "was"), "reason", "left").withColumn("was", F.coalesce("was", F.lit(0)))
    return both.where("pages > was")


def inventory_diff(baseline: DataFrame, current: DataFrame, top: int | None = None) -> DataFrame:
    """Entries `(path, bytes)` added, removed and changed; ranked largest first, changed ones by growth, then by path."""
    both = baseline.withColumnRenamed("bytes", "before").join(current.withColumnRenamed("bytes", "after"), "path", "full_outer")
    both = both.where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    weight = F.when(change == "added", F.col("after")).when(change == "removed", F.col("before")).otherwise(F.col("after") - F.col("before"))
    rows = both.select("path", change.alias("change"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), weight.alias("weight"))
    if top is None:
        return rows
    order = W.partitionBy("change").orderBy(F.desc("weight"), "path")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def recent(opened: DataFrame, capacity: int = 12) -> DataFrame:
    """Per user the locations opened last `(user_id, location, opened_at, page)`, newest first, each once.

    A location keeps the last page that was noted for it.
    """
    moment = F.struct("opened_at", "seq")
    state = opened.groupBy("user_id", "location").agg(
        F.max(moment).alias("_m"), F.max_by("page", F.when(F.col("page").isNotNull(), moment)).alias("page"))
    flat = state.select("user_id", "location", F.col("_m.opened_at").alias("opened_at"), F.col("_m.seq").alias("seq"), F.coalesce("page", F.lit(1)).alias("page"))
    order = W.partitionBy("user_id").orderBy(F.desc("opened_at"), F.desc("seq"))
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= capacity)
