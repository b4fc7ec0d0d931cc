"""Numbers, dates and special texts of form fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,10)"

# ---- fixed values --------------------------------------------------------------------------------
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
# Date and time tokens of field patterns and what they are called here; minutes are MM.
TOKENS = {
    "d": {1: "d", 2: "dd", 3: "EEE", 4: "EEEE"}, "m": {1: "M", 2: "MM", 3: "MMM", 4: "MMMM"}, "y": {2: "yy", 4: "yyyy"},
    "H": {1: "H", 2: "HH"}, "h": {1: "h", 2: "hh"}, "M": {1: "m", 2: "mm"}, "s": {1: "s", 2: "ss"},
}
# Digits a special text may have: zip, zip+4, phone, social security number.
SPECIAL_DIGITS = {0: (5,), 1: (9,), 2: (7, 10), 3: (9,)}
SPECIAL_NAMES = {0: "a 5-digit ZIP code.", 1: "a ZIP+4 code (99999-9999).", 2: "a phone number.", 3: "a Social Security number (999-99-9999)."}
FORMAT_ERROR = "The value entered does not match the format of the field: "
MASK_CLASSES = {"9": r"\p{Nd}", "A": r"\p{L}", "O": r"[\p{L}\p{Nd}]", "X": "."}
# --------------------------------------------------------------------------------------------------


def number_text(text: Column, style: Column | int = 0) -> Column:
    """A number as stored or typed, as plain digits: plain first, then by separator style; null when it is none."""
    style = F.lit(style) if isinstance(style, int) else style
    t = F.trim(text)
    plain = F.regexp_like(t, F.lit(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"))
    comma = style.isin(2, 3)
    kept = F.when(comma, F.translate(F.regexp_replace(t, r"[^\d,]", ""), ",", ".")).otherwise(F.regexp_replace(t, r"[^\d.]", ""))
    negative = (F.locate("-", t) > 0) | ((F.locate("(", t) > 0) & (F.locate(")", t) > 0))
    loose = F.when(F.regexp_like(kept, F.lit(r"^\d*\.?\d*$")) & F.regexp_like(kept, F.lit(r"\d")), kept)
    return F.when(plain, t).otherwise(F.when(negative, F.concat(F.lit("-"), loose)).otherwise(loose))


def parse_number(text: Column, style: Column | int = 0) -> Column:
    """The number a text stands for, to ten places."""
    return number_text(text, style).try_cast(DECIMAL)


def canonical(value: Column) -> Column:
    """A decimal as text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_number(value: Column, decimals: int, style: Column | int) -> Column:
    """The absolute value with its separators, rounded half away from zero."""
    style = F.lit(style) if isinstance(style, int) else style
    text = F.format_number(F.round(F.abs(value), decimals), decimals)
    return (
        F.when(style == 0, text).when(style == 1, F.translate(text, ",", "")).when(style == 2, F.translate(text, ",.", ".,"))
        .when(style == 3, F.translate(F.translate(text, ",", ""), ".", ",")).otherwise(F.translate(text, ",", "'"))
    )


def special(value: Column, kind: int) -> Column:
    """Digits set as a zip code, phone or social security number; other texts as they are."""
    d = F.regexp_replace(value, r"\P{Nd}", "")
    cut = lambda *parts: F.concat(*[F.substring(d, p[0], p[1]) if isinstance(p, tuple) else F.lit(p) for p in parts])
    n = F.length(d)
    shown = {
        0: F.when(n == 5, d),
        1: F.when(n == 9, cut((1, 5), "-", (6, 4))),
        2: F.when(n == 10, cut("(", (1, 3), ") ", (4, 3), "-", (7, 4))).when(n == 7, cut((1, 3), "-", (4, 4))),
        3: F.when(n == 9, cut((1, 3), "-", (4, 2), "-", (6, 4))),
    }[kind]
    return F.coalesce(shown, value)


def parse_date(text: Column, pattern: str, today_year: Column | None = None) -> Column:
    """A date typed in any reasonable way, read in the order the pattern puts day, month and year."""
    numbers = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))
    starts = lambda names, w: F.exists(F.array(*map(F.lit, names)), lambda name: (F.length(w) >= 3) & name.startswith(w))
    half = lambda w: w.isin("am", "a", "pm", "p")
    known = F.forall(words, lambda w: half(w) | starts(MONTHS, w) | starts(DAYS, w))
    months = F.filter(words, lambda w: ~half(w) & starts(MONTHS, w))
    named = F.size(months) > 0
    last_month = F.element_at(months, -1)
    month_no = F.aggregate(
        F.array(*[F.struct(F.lit(m).alias("n"), F.lit(i + 1).alias("i")) for i, m in enumerate(MONTHS)]), F.lit(0),
        lambda acc, m: F.when((acc == 0) & m["n"].startswith(last_month), m["i"]).otherwise(acc))
    year_now = F.year(F.current_date()) if today_year is None else today_year
    order = [k for k in dict.fromkeys(pattern) if k in "dmy"]
    timed = "H" in pattern or "h" in pattern or "MM" in pattern

    def read(sequence: list[str], with_name: bool) -> Column:
        at = {k: F.get(numbers, F.lit(i)).try_cast("int") for i, k in enumerate(sequence)}
        month = month_no if with_name else at.get("m", F.lit(None).cast("int"))
        day = F.coalesce(at["d"], F.lit(1)) if "d" in at else F.lit(1)
        y = at.get("y")
        year = year_now if y is None else F.coalesce(F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y), year_now)
        if not order:
            year, month, day = F.lit(2000), F.lit(1), F.lit(1)
        base = len(sequence)
        part = lambda i: F.coalesce(F.get(numbers, F.lit(base + i)).try_cast("int"), F.lit(0)) if timed else F.lit(0)
        hour = part(0)
        pm, am = F.exists(words, lambda w: w.isin("pm", "p")), F.exists(words, lambda w: w.isin("am", "a"))
        hour = F.when(pm & (hour < 12), hour + 12).when(am & (hour == 12), 0).otherwise(hour)
        enough = F.size(numbers) <= base + (3 if timed else 0)
        return F.when(enough, F.try_make_timestamp(year, month, day, hour, part(1), part(2)))

    without = [k for k in order if k != "m"]
    value = F.when(named, read(without, True)).otherwise(read(order, False)) if order else read([], False)
    some = (F.size(numbers) + F.size(words)) > 0
    short = F.forall(numbers, lambda x: F.length(x) <= 8)
    return F.when(some & short & known, value)


def format_date(moment: Column, pattern: str) -> Column:
    """A moment shown by a field pattern."""
    parts = []
    for run in re.finditer(r"(.)\1*", pattern, re.DOTALL):
        ch, n = run.group(1), len(run.group())
        if ch == "t":
            half = F.lower(F.date_format(moment, "a"))
            parts.append(F.substring(half, 1, 1) if n == 1 else half)
        elif ch in TOKENS:
            names = TOKENS[ch]
            parts.append(F.date_format(moment, names.get(n, names[max(names)])))
        else:
            parts.append(F.lit(run.group()))
    return F.concat(*parts) if parts else F.lit("")


def mask_pattern(mask: str) -> str:
    """A mask of 9, A, O, X and literals as a regular expression."""
    return "^" + "".join(MASK_CLASSES.get(ch, re.escape(ch)) for ch in mask) + "$"
