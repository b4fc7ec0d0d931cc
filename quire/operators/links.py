"""Links, active content, permissions and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# ---- fixed values --------------------------------------------------------------------------------
MAX_URI = 8192
MAX_DETAILS = 10
MAX_PAGES = 50
NAMED_ACTIONS = {"NextPage": "NextPage", "PrevPage": "PreviousPage", "FirstPage": "FirstPage", "LastPage": "LastPage"}
SEVERITY = {"JavaScript": "Elevated", "EmbeddedFile": "Elevated", "LaunchAction": "Elevated", "Encryption": "Informational", "ExternalLink": "Informational"}
EXECUTABLE = (
    ".exe", ".com", ".scr", ".pif", ".cpl", ".msi", ".msp", ".dll", ".sys", ".bat", ".cmd", ".ps1", ".psm1", ".vbs", ".vbe", ".js", ".jse",
    ".wsf", ".wsh", ".hta", ".jar", ".lnk", ".reg", ".inf", ".scf", ".url", ".chm", ".docm", ".xlsm", ".pptm", ".dotm", ".xlam", ".iso", ".img",
)
# --------------------------------------------------------------------------------------------------

HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script\s*>"
EMBED = r"(?is)<(?:iframe|embed|object|applet)\b[^>]*>(?:.*?</(?:iframe|object|applet)\s*>)?"
BEGUN = r"(?i)<|href"  # no more elements can arise than brackets and links there are
LAUNCH = r"""(?i)\shref\s*=\s*["']((?:file|launch):[^"']*)["']"""
ODD_CHARACTERS = r"[\p{Z}\s\p{Cc}\p{Cf}\p{Co}\p{Cn}\p{Cs}\\]"
HOST = r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]/?#]+\]|[^/?#:@\[\]]+)(?::\d*)?(?:[/?#]|$)"


def extract_links(pages: DataFrame, include_url: bool = False) -> DataFrame:
    """The links of HTML pages in order, as URI actions; the page's own address first when asked for."""
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    uris = F.concat(F.array("url"), found) if include_url else found
    rows = pages.select("page_id", F.posexplode(uris).alias("ord", "uri"))
    return rows.select(
        F.col("page_id").alias("doc_id"), "ord", F.lit("URI").alias("action"), F.lit(None).cast("string").alias("name"), "uri",
        F.lit(None).cast("int").alias("target_page"), F.lit(1).alias("page_count"),
    )


def is_web_uri(uri: Column) -> Column:
    """An absolute http, https or mailto address a reader may be offered to open."""
    text = F.trim(uri)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    safe = (F.length(text) > 0) & (F.length(text) <= MAX_URI) & ~F.regexp_like(text, F.lit(ODD_CHARACTERS))
    return safe & ((scheme == "mailto") | (scheme.isin("http", "https") & F.regexp_like(text, F.lit(HOST))))


def classify_links(links: DataFrame) -> DataFrame:
    """Where each link goes: a page, a relative page, a web address, a blocked address, outside or nowhere."""
    named = F.lit(None).cast("string")
    for action, kind in NAMED_ACTIONS.items():
        named = F.when(F.col("name") == action, kind).otherwise(named)
    inside = (F.col("target_page") >= 1) & (F.col("target_page") <= F.col("page_count"))
    kind = (
        F.when(F.col("action").isNull() | (F.col("action") == "GoTo"), F.when(inside, "Page").otherwise("None"))
        .when(F.col("action") == "Named", F.coalesce(named, F.lit("External")))
        .when(F.col("action") == "URI", F.when(is_web_uri(F.coalesce("uri", F.lit(""))), "WebUri").otherwise("BlockedUri"))
        .otherwise("External")
    )
    return links.withColumn("kind", kind)


def link_counts(classified: DataFrame) -> DataFrame:
    """How many links of each kind a document has."""
    return classified.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("links"))


def link_hosts(classified: DataFrame) -> DataFrame:
    """Links and documents per host and scheme; a mail link shows its address."""
    text = F.trim("uri")
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    address = F.trim(F.url_decode(F.regexp_extract(text, r"^[^:]*:([^?]*)", 1)))
    host = F.when(scheme == "mailto", F.when(address != "", address).otherwise("(no address)")).otherwise(F.lower(F.regexp_extract(text, HOST, 1)))
    rows = classified.where("kind = 'WebUri'").select("doc_id", scheme.alias("scheme"), host.alias("host"))
    per_doc = rows.groupBy("scheme", "host", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_doc.groupBy("scheme", "host").agg(F.sum("_n").alias("links"), F.count(F.lit(1)).alias("documents"))


def active_items(pages: DataFrame) -> DataFrame:
    """Scripts, embedded content, launch links and outside links of HTML pages `(doc_id, page_no, url, html)`."""
    entry = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("detail")))
    found = F.concat(
        entry("JavaScript", F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))),
        entry("EmbeddedFile", F.regexp_extract_all("html", F.lit(EMBED), F.lit(0))),
        entry("LaunchAction", F.regexp_extract_all("html", F.lit(LAUNCH), F.lit(1))),
        entry("ExternalLink", F.filter(F.concat(F.array("url"), F.regexp_extract_all("html", F.lit(HREF), F.lit(1))), is_web_uri)),
    )
    rows = pages.select("doc_id", "page_no", F.posexplode(found).alias("ord", "_i"))
    return rows.select("doc_id", "page_no", "ord", "_i.kind", "_i.detail")


def safety_report(items: DataFrame, max_details: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Per document and kind: severity, how many, and the details in order.

    `max_details` shows only the first of them; with `max_pages` link and launch items count on the first pages only.
    """
    seen = items if max_pages is None else items.where(~F.col("kind").isin("LaunchAction", "ExternalLink") | (F.col("page_no") <= max_pages))
    severity = F.lit("Informational")
    for kind, level in SEVERITY.items():
        severity = F.when(F.col("kind") == kind, level).otherwise(severity)
    counts = seen.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("count"))
    shown = F.when((F.col("kind") == "JavaScript") & (F.trim("detail") == ""), F.concat(F.lit("(unnamed script "), F.col("_rn"), F.lit(")"))).otherwise(F.col("detail"))
    order = W.partitionBy("doc_id", "kind").orderBy("page_no", "ord")
    first = (
        seen.where("detail <> '' or kind = 'JavaScript'")
        .withColumn("_rn", F.row_number().over(order)).where(F.lit(True) if max_details is None else F.col("_rn") <= max_details)
        .groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(F.struct("_rn", shown.alias("d")))).alias("_d"))
    )
    joined = counts.join(first, ["doc_id", "kind"], "left")
    return joined.select("doc_id", "kind", severity.alias("severity"), "count", F.transform("_d", lambda s: s["d"]).alias("details"))


def safety_verdicts(pages: DataFrame, report: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Per document: clean when nothing is Elevated, limited when it has more pages than the report looked at."""
    sizes_ = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    worst = report.groupBy("doc_id").agg(F.count_if(F.col("severity") == "Elevated").alias("_e"), F.count(F.lit(1)).alias("findings"))
    joined = sizes_.join(worst, "doc_id", "left").na.fill(0, ["_e", "findings"])
    return joined.select("doc_id", "pages", "findings", (F.col("_e") == 0).alias("clean"), (F.lit(False) if max_pages is None else F.col("pages") > max_pages).alias("limited"))


def sanitize(pages: DataFrame) -> DataFrame:
    """Active content taken out, with how many of each kind went and whether any is left."""
    count = lambda column, pattern: F.regexp_count(column, F.lit(pattern)).cast("long")
    # A removal can join what stood around it, so removing goes on, once for each element that begins, while any is left.
    strip = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, SCRIPT, ""), EMBED, ""), LAUNCH, ' href=""')
    begun = F.regexp_count("html", F.lit(BEGUN))
    state = lambda c: F.struct(c.alias("text"), (c.rlike(SCRIPT) | c.rlike(EMBED) | c.rlike(LAUNCH)).alias("live"))
    again = lambda done, _: F.when(done["live"], F.transform(F.array(strip(done["text"])), state)[0]).otherwise(done)
    clean = F.aggregate(F.sequence(F.lit(0), begun), state(F.col("html")), again, lambda done: done["text"])
    staged = pages.withColumn("clean", clean)
    left = count("clean", SCRIPT) + count("clean", EMBED) + count("clean", LAUNCH)
    return staged.select(
        *[c for c in pages.columns if c != "html"], F.col("clean").alias("html"),
        count("html", SCRIPT).alias("scripts"), count("html", EMBED).alias("embedded"), count("html", LAUNCH).alias("launches"),
        F.when(left == 0, "clean").otherwise("failed").alias("verdict"),
    )


def permission_audit(docs: DataFrame) -> DataFrame:
    """What permission flags `(doc_id, flags, revision, unrestricted)` allow, and a summary of what they forbid."""
    bit = lambda n: F.col("flags").bitwiseAND(1 << (n - 1)) != 0
    free, old = F.col("unrestricted"), F.col("revision") <= 2
    either = lambda base, n: free | F.when(old, base).otherwise(base | bit(n))
    allowed = docs.withColumns({
        "can_print": free | bit(3),
        "can_print_high": free | F.when(old, bit(3)).otherwise(bit(3) & bit(12)),
        "can_modify": free | bit(4),
        "can_copy": free | bit(5),
        "can_annotate": free | bit(6),
        "can_fill": either(bit(6), 9),
        "can_extract": either(bit(5), 10),
        "can_assemble": either(bit(4), 11),
    })
    denied = F.filter(F.array(
        F.when(~F.col("can_print"), "printing").when(~F.col("can_print_high"), "high-quality printing"),
        F.when(~F.col("can_copy"), "copying"), F.when(~F.col("can_annotate"), "commenting"), F.when(~F.col("can_fill"), "form filling"),
        F.when(~F.col("can_modify"), "editing"), F.when(~F.col("can_assemble"), "page assembly"),
    ), lambda d: d.isNotNull())
    text = F.when(F.size(denied) > 0, F.concat(F.lit("Not allowed: "), F.array_join(denied, ", "))).otherwise("")
    return allowed.withColumn("denied", denied).withColumn("summary", text)


def restriction_counts(audited: DataFrame) -> DataFrame:
    """Documents per summary text."""
    return audited.groupBy("summary").agg(F.count(F.lit(1)).alias("documents"))


def policy_violations(docs: DataFrame, items: DataFrame, max_bytes: int = 2 * 1024**3, allowed: tuple[str, ...] = ("ExternalLink", "AttachmentExtraction")) -> DataFrame:
    """Documents over the size ceiling and actions outside the allow-list, with how often."""
    large = docs.where(F.col("bytes") > max_bytes).select("doc_id", F.lit("MaxDocumentSizeBytes").alias("rule"), F.lit(1).cast("long").alias("count"))
    actions = items.where(~F.col("kind").isin(*allowed)).groupBy("doc_id", F.col("kind").alias("rule")).agg(F.count(F.lit(1)).alias("count"))
    return large.unionByName(actions)


def attachment_audit(attachments: DataFrame) -> DataFrame:
    """Attachments with a name to show, their size and whether the extension can run."""
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("key"), F.lit("")), F.concat(F.lit("attachment "), F.col("ord") + 1))
    rows = attachments.withColumn("shown_name", name)
    extension = F.lower(F.regexp_extract("shown_name", r"(\.[^.]*)$", 1))
    return rows.select("doc_id", "ord", "shown_name", F.coalesce("bytes", F.lit(-1)).alias("bytes"), extension.isin(*EXECUTABLE).alias("executable"))


