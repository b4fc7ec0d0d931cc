"""Arranging, merging, splitting and stamping pages."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import blocks
from quire.plans.checkpoints import cut

WIDTH = 65536


def _renumber(pages: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "page_no") -> DataFrame:
    """Pages numbered from 1 in `order` (its first column an integer), whatever the size of a document."""
    cut = blocks.by_value(pages, order[0], WIDTH)
    numbered = blocks.scan(cut, keys, order, _new=("number", None))
    return numbered.withColumn(out, F.col("_new")).drop("_new")


def arrange(pages: DataFrame, arrangement: DataFrame) -> DataFrame:
    """The pages an arrangement `(doc_id, ord, source_page, turn)` lists, in its order and turned as it says.

    One list can move, drop, repeat and turn pages. Entries for pages a document lacks are left out;
    `arrangement_errors` lists them.
    """
    wanted = arrangement.select("doc_id", "ord", F.col("source_page").alias("page_no"), "turn")
    taken = wanted.join(pages, ["doc_id", "page_no"])
    turned = taken.withColumn("rotation", F.pmod(F.col("rotation") + F.col("turn"), F.lit(360)))
    renamed = turned.withColumnRenamed("page_no", "source_page").drop("turn")
    return _renumber(renamed, ["doc_id"], ["ord"]).drop("ord")


def arrangement_errors(pages: DataFrame, arrangement: DataFrame) -> DataFrame:
    """Entries of an arrangement that name a page outside their document."""
    return arrangement.join(pages.select("doc_id", F.col("page_no").alias("source_page")), ["doc_id", "source_page"], "left_anti")


def extract_pages(pages: DataFrame, picks: DataFrame) -> DataFrame:
    """The picked pages `(doc_id, ord, source_page)` in the order picked; invalid picks are ignored."""
    return arrange(pages, picks.withColumn("turn", F.lit(0)))


def delete_pages(pages: DataFrame, drops: DataFrame) -> DataFrame:
    """The pages left after dropping `(doc_id, page_no)`, renumbered."""
    left = pages.join(drops.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti").withColumn("source_page", F.col("page_no"))
    return _renumber(left, ["doc_id"], ["page_no"])


def insert_blank(pages: DataFrame, blanks: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """A blank page after each `(doc_id, index)`; an index past the end puts it last."""
    counts = pages.groupBy("doc_id").agg(F.max("page_no").alias("_last"))
    at = F.greatest(F.least("index", "_last"), F.lit(0))
    new = blanks.join(counts, "doc_id").select(
        "doc_id", at.alias("page_no"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(0).alias("rotation"),
        F.lit(None).cast("int").alias("source_page"), F.lit(1).alias("_blank"))
    old = pages.select("doc_id", "page_no", "width", "height", "rotation", F.col("page_no").alias("source_page"), F.lit(0).alias("_blank"))
    return _renumber(old.unionByName(new), ["doc_id"], ["page_no", "_blank"]).drop("_blank")


def merge(sources: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents put together: `sources (target_id, ord, doc_id, list_title, title)` and their pages.

    Offsets are summed over the sources, one row per document; pages only look theirs up. Returns the
    numbered pages and one outline entry per source.
    """
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_count"))
    sized = blocks.by_value(sources.join(counts, "doc_id"), "ord", WIDTH)
    placed = blocks.scan(sized, ["target_id"], ["ord"], _upto=("sum", "_count"), _nth=("number", None))
    offsets = placed.withColumn("_before", F.col("_upto") - F.col("_count"))
    merged = pages.join(offsets.select("target_id", "doc_id", "_before"), "doc_id").select(
        "target_id", (F.col("_before") + F.col("page_no")).alias("page_no"), "doc_id", F.col("page_no").alias("source_page"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    title = F.coalesce(some("list_title"), some("title"), F.concat(F.lit("Document "), F.col("_nth")))
    outline = offsets.select("target_id", F.col("_nth").alias("ord"), title.alias("title"), (F.col("_before") + 1).alias("page_no"))
    return merged, outline


def split(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """Part k takes the next pages by `counts (doc_id, part, pages)`; pages after the last part are left out.

    Pages and part starts are put in one order and each page takes the last start at or before it, so no
    page meets every part.
    """
    sized = blocks.scan(blocks.by_value(counts, "part", WIDTH), ["doc_id"], ["part"], _upto=("sum", "pages"))
    first = F.col("_upto") - F.col("pages") + 1
    span = F.struct(first.cast("long").alias("first"), F.col("_upto").cast("long").alias("last"), F.col("part").cast("long").alias("part"))
    starts = sized.where("pages > 0").select("doc_id", first.cast("long").alias("page_no"), F.lit(0).alias("_kind"), span.alias("_span"))
    rows = pages.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<first:bigint,last:bigint,part:bigint>").alias("_span"))
    both = blocks.by_value(starts.unionByName(rows), "page_no", WIDTH)
    found = blocks.scan(both, ["doc_id"], ["page_no", "_kind"], _in=("max_before", "_span")).where("_kind = 1 and page_no <= _in.last")
    return found.select("doc_id", F.col("_in.part").alias("part"), (F.col("page_no") - F.col("_in.first") + 1).alias("page_no"), F.col("page_no").alias("source_page"))


def page_range(pages: DataFrame, first: int = 1, last: int | None = None, subset: str = "all") -> DataFrame:
    """Pages from `first` to `last`, all of them or only the odd or even ones."""
    kept = F.col("page_no") >= max(1, first)
    if last is not None:
        kept &= F.col("page_no") <= last
    if subset != "all":
        kept &= F.pmod("page_no", F.lit(2)) == (1 if subset == "odd" else 0)
    return pages.where(kept)


# ---- fixed values: the words of header and footer templates
OPENING, CLOSING = "<<", ">>"
TOTAL, NUMBER, BATES, DATE = "n", "1", "bates", "date"
FILE_NAMES = ("file", "filename", "file name")
PAGE_WORD, COUNT_WORDS = "page", ("/", "of")
DATE_LETTERS, DATE_MARKS = set("dmy"), "/-. "
# ------------------------------------------------------------------------------------------------


def _date(day: Column, pattern: str) -> Column:
    """A date by letters d, m and y; three d are the short name of the day, more the long one."""
    runs = ["".join(run) for _, run in groupby(pattern)]
    java = "".join({3: "EEE"}.get(len(r), "EEEE") if r[0] == "d" and len(r) > 2 else r for r in runs)
    return F.date_format(day, java)


def _page_words(name: str) -> tuple[str, str | None] | None:
    """What stands before the page number, and between it and the total if there is one; None for other tokens."""
    before, one, after = name.partition(NUMBER)
    word = before.strip().lower()
    if not one or word not in ("", PAGE_WORD) or (word and not before[-1].isspace()):
        return None
    if not after:
        return before, None
    between, total = after[:-1], after[-1:]
    return (before, between) if total.lower() == TOTAL and between.strip().lower() in COUNT_WORDS else None


def _is_date(name: str) -> bool:
    marks = str.maketrans(DATE_MARKS, "/" * len(DATE_MARKS))
    return all(part and set(part) <= DATE_LETTERS for part in name.translate(marks).split("/"))


def expand_template(template: str, page: Column, count: Column, bates: Column, day: Column, file: Column, date_format: str = "yyyy-MM-dd", start_page: int = 1) -> Column:
    """A header or footer's text for each page: known tokens replaced, unknown ones kept."""
    number, total = (page - 1 + start_page).cast("string"), (count - 1 + start_page).cast("string")
    words = {TOTAL: [total], BATES: [F.coalesce(bates, F.lit(""))], DATE: [_date(day, date_format)]} | {f: [file] for f in FILE_NAMES}

    def value(name: str) -> list[Column] | None:
        low = name.lower()
        if low in words:
            return words[low]
        if (around := _page_words(name)) is not None:
            before, between = around
            return [F.lit(before), number] + ([] if between is None else [F.lit(between), total])
        return [_date(day, low.replace("m", "M"))] if _is_date(low) else None

    first, *pieces = template.split(OPENING)
    parts = [F.lit(first)]
    for piece in pieces:
        name, end, rest = piece.partition(CLOSING)
        found = value(name.strip()) if end and "<" not in name and ">" not in name else None
        parts += [F.lit(OPENING + piece)] if found is None else [*found, F.lit(rest)]
    return F.concat(*parts)


def bates_text(number: Column, prefix: str = "", suffix: str = "", digits: int = 6) -> Column:
    text = F.greatest(number, F.lit(0)).cast("string")
    width = min(max(digits, 1), 20)
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.concat(F.lit(prefix), padded, F.lit(suffix))


def stamp(pages: DataFrame, template: str, day: Column, file: Column, prefix: str = "", suffix: str = "", start: int = 1, digits: int = 6, **options) -> DataFrame:
    """A running number over all selected pages of all documents in order, and the template filled per page.

    `pages (doc_id, page_no, page_count)`: the selected pages. Offsets are summed over documents, ranks
    inside each document.
    """
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_count"))
    offsets = blocks.scan(blocks.by_value(counts, "doc_id", WIDTH), [], ["doc_id"], _upto=("sum", "_count"))
    ranked = blocks.scan(blocks.by_value(pages, "page_no", WIDTH), ["doc_id"], ["page_no"], _rank=("number", None))
    joined = ranked.join(offsets.select("doc_id", (F.col("_upto") - F.col("_count")).alias("_before")), "doc_id")
    numbered = joined.withColumn("bates", bates_text(F.col("_before") + F.col("_rank") - 1 + start, prefix, suffix, digits))
    text = expand_template(template, F.col("page_no"), F.col("page_count"), F.col("bates"), day, file, **options)
    return numbered.withColumn("stamp", text).drop("_before", "_rank")


def outline_spans(nodes: DataFrame, page_counts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """An outline `(doc_id, node_id, parent_id, ord, title, page_no)` flattened: level, path and page span.

    A node ends where the next entry at its level or above begins: at its next sibling, else where its
    parent ends. Levels are walked from the top, one join each, down to `max_depth` if it is given.
    """
    by_parent = blocks.by_value(nodes.withColumn("parent_id", F.coalesce("parent_id", F.lit(0))), "ord", WIDTH)
    placed = cut(blocks.scan(by_parent, ["doc_id", "parent_id"], ["ord"], _next=("next", "page_no")))
    level = placed.where("parent_id = 0").select("*", F.lit(0).alias("level"), F.col("title").alias("path"), F.col("_next").alias("next_page"))
    levels = [level]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        above = levels[-1].select("doc_id", F.col("node_id").alias("parent_id"), F.col("path").alias("_path"), F.col("next_page").alias("_parent_next"))
        level = cut(placed.where("parent_id <> 0").join(above, ["doc_id", "parent_id"]).select(
            *placed.columns, F.lit(depth).alias("level"), F.concat_ws(" > ", "_path", "title").alias("path"), F.coalesce("_next", "_parent_next").alias("next_page")))
        if level.isEmpty():
            break
        levels.append(level)
    flat = levels[0]
    for more in levels[1:]:
        flat = flat.unionByName(more)
    flat = flat.join(page_counts.select("doc_id", "page_count"), "doc_id")
    last = F.coalesce(F.greatest("page_no", F.col("next_page") - 1), "page_count")
    return flat.select("doc_id", "node_id", "level", "path", F.col("page_no").alias("first_page"), last.alias("last_page"))


def remap_targets(links: DataFrame, page_map: DataFrame) -> DataFrame:
    """Links whose target page is still there, pointing at its first new place. `page_map (doc_id, source_page, page_no)`."""
    first = page_map.groupBy("doc_id", "source_page").agg(F.min("page_no").alias("_new"))
    moved = links.join(first.withColumnRenamed("source_page", "target_page"), ["doc_id", "target_page"])
    return moved.withColumn("target_page", F.col("_new")).drop("_new")
