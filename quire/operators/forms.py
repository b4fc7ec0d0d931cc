"""Form data: shown and checked values, calculations, imports and resets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import exactnumbers as exact
from quire.functions import formvalues as V
from quire.plans import folds, sizes
from quire.plans.checkpoints import cut

# ---- fixed values
MAX_CHANGES, MAX_CHARACTERS = 10_000, 10_000
# -----------------


@dataclass(frozen=True)
class FieldRule:
    """How fields of a name are shown and checked."""

    name: str
    format: str = ""  # number, percent, date, special, mask or nothing
    decimals: int = 0
    separator_style: int = 0  # 0 1,234.56  1 1234.56  2 1.234,56  3 1234,56  4 1'234.56
    negative_style: int = 0  # 0 minus, 1 red, 2 parentheses, 3 red parentheses
    currency: str = ""
    currency_before: bool = True
    percent_before: bool = False
    pattern: str = ""
    special: int = 0
    mask: str = ""
    least: float | None = None
    most: float | None = None


def _per_rule(rules: Sequence[FieldRule], build, otherwise: Column) -> Column:
    """One branch per rule; the rules are a short list written by the caller."""
    if len(rules) > sizes.MAX_RULES:
        raise ValueError("too many field rules")
    column = None
    for rule in rules:
        column = (F.when if column is None else column.when)(F.col("name") == rule.name, build(rule))
    return otherwise if column is None else column.otherwise(otherwise)


def _shown(rule: FieldRule) -> Column:
    value = F.col("value")
    as_is = F.struct(value.alias("text"), F.lit(False).alias("red"))
    shown = lambda text, red=False: F.struct(text.alias("text"), F.lit(red).alias("red"))
    if rule.format == "number":
        n = V.parse_number(value, rule.separator_style)
        body = V.format_number(n, rule.decimals, rule.separator_style)
        if rule.currency:
            body = F.concat(F.lit(rule.currency), body) if rule.currency_before else F.concat(body, F.lit(rule.currency))
        wrapped = F.concat(F.lit("("), body, F.lit(")"))
        negative = {0: shown(F.concat(F.lit("-"), body)), 1: shown(body, True), 2: shown(wrapped), 3: shown(wrapped, True)}[rule.negative_style]
        return F.when(n.isNull(), as_is).when((n < 0) & (F.round(n, rule.decimals) != 0), negative).otherwise(shown(body))
    if rule.format == "percent":
        n = V.parse_number(value, rule.separator_style)
        body = F.concat(F.when(n < 0, "-").otherwise(""), V.format_number(n * 100, rule.decimals, rule.separator_style))
        return F.when(n.isNull(), as_is).otherwise(shown(F.concat(F.lit("%"), body) if rule.percent_before else F.concat(body, F.lit("%"))))
    if rule.format == "date":
        moment = V.parse_date(value, rule.pattern)
        return F.when(moment.isNull(), as_is).otherwise(shown(V.format_date(moment, rule.pattern)))
    if rule.format == "special":
        return shown(V.special(value, rule.special))
    return as_is


def display_values(fields: DataFrame, rules: Sequence[FieldRule]) -> DataFrame:
    """Stored values `(…, name, value)` as their fields show them, and whether in red."""
    as_is = F.struct(F.col("value").alias("text"), F.lit(False).alias("red"))
    shown = F.when(F.col("value") == "", as_is).otherwise(_per_rule(rules, _shown, as_is))
    return fields.withColumn("_d", shown).select(*fields.columns, "_d.text", "_d.red")


def _number_text(value: float) -> str:
    return str(int(value)) if value == int(value) else repr(value)


def _checked(rule: FieldRule) -> Column:
    text = F.trim("value")
    result = lambda stored, error: F.struct(stored.alias("stored"), F.lit(error).cast("string").alias("error"))
    refused = lambda message: result(F.lit(None).cast("string"), message)
    number, stored, branches = None, F.col("value"), []
    if rule.format in ("number", "percent"):
        t = F.replace(text, F.lit(rule.currency), F.lit("")) if rule.currency else text
        t = F.translate(t, "%", "")
        number = V.parse_number(t, rule.separator_style)
        branches.append((number.isNull() | F.regexp_like(t, F.lit(r"[^\d\s.,'()\-+]")), refused(V.FORMAT_ERROR + "enter a number.")))
        if rule.format == "percent":
            number = F.when(F.locate("%", text) > 0, number * F.lit("0.01").cast("decimal(3,2)")).otherwise(number)
        stored = V.canonical(number.cast(V.DECIMAL))
    elif rule.format == "date":
        branches.append((V.parse_date(text, rule.pattern).isNull(), refused(f"{V.FORMAT_ERROR}{rule.pattern}.")))
    elif rule.format == "special":
        digits = F.length(F.regexp_replace(text, r"\P{Nd}", ""))
        wrong = ~digits.isin(*V.SPECIAL_DIGITS[rule.special]) | F.regexp_like(text, F.lit(r"[^\d\s()\-.]"))
        branches.append((wrong, refused(V.FORMAT_ERROR + V.SPECIAL_NAMES[rule.special])))
    elif rule.format == "mask" and rule.mask:
        branches.append((~F.regexp_like(text, F.lit(V.mask_pattern(rule.mask))), refused(f"{V.FORMAT_ERROR}{rule.mask}.")))
    if rule.least is not None or rule.most is not None:
        v = (number if number is not None else V.parse_number(text, rule.separator_style)).cast("double")
        low = F.lit(False) if rule.least is None else v < rule.least
        high = F.lit(False) if rule.most is None else v > rule.most
        limits = [f"greater than or equal to {_number_text(rule.least)}"] if rule.least is not None else []
        limits += [f"less than or equal to {_number_text(rule.most)}"] if rule.most is not None else []
        branches.append((v.isNotNull() & (low | high), refused(f"Invalid value: must be {' and '.join(limits)}.")))
    answer = result(stored, None)
    for broken, message in reversed(branches):
        answer = F.when(broken, message).otherwise(answer)
    return F.when(text == "", result(F.lit(""), None)).otherwise(answer)


def validate(values: DataFrame, rules: Sequence[FieldRule]) -> DataFrame:
    """Typed values `(…, name, value)` as they would be stored, or why they are refused."""
    free = F.struct(F.col("value").alias("stored"), F.lit(None).cast("string").alias("error"))
    return values.withColumn("_c", _per_rule(rules, _checked, free)).select(*values.columns, "_c.stored", "_c.error")


@dataclass(frozen=True)
class Calculation:
    """A field calculated from others: an operation over field or group names, or an expression."""

    name: str
    operation: str = ""
    fields: tuple[str, ...] = ()
    expression: str = ""


def _numbers(fields: DataFrame) -> DataFrame:
    """Each field's number as text, read by its own `separator_style` where the table has one; 0 where it holds none."""
    style = F.coalesce("separator_style", F.lit(0)) if "separator_style" in fields.columns else F.lit(0)
    place = F.col("seq") if "seq" in fields.columns else F.col("name")
    return fields.select("doc_id", "name", place.alias("_place"), F.coalesce(V.number_text(F.col("value"), style), F.lit("0")).alias("_t"))


def _prefixes() -> Column:
    """A field's own name and the dotted prefixes of it."""
    parts = F.split("name", r"\.")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ".")))


def _under(name: str) -> Column:
    return (F.col("name") == name) | F.col("name").startswith(name + ".")


def _matching(names: Sequence[str]) -> Column:
    """The names a field counts under: a few are compared with it one by one, many are looked up by its prefixes."""
    if not names:
        return F.array().cast("array<string>")
    if len(names) <= 16:
        return F.array_compact(F.array(*[F.when(_under(n), F.lit(n)) for n in names]))
    return F.filter(_prefixes(), lambda p: p.isin(*names))


def _named(fields: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    """The numbers behind each (target, name): the field of that name or every field under it.

    A field meets its own name and the dotted prefixes of it, never a whole document's names.
    """
    spread = _numbers(fields).select("doc_id", "_place", "_t", F.explode(_prefixes()).alias("_key"))
    wanted = sizes.rules(fields.sparkSession, names, "target string, _key string")
    return spread.join(wanted, "_key")


def _each(docs: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Every document once per calculation."""
    rows = F.array(*[F.struct(F.lit(target).alias("target"), F.lit(op).alias("_op")) for target, op in wanted])
    return docs.select("doc_id", F.explode(rows).alias("_r")).select("doc_id", "_r.*")


# Numbers of few digits are added up as they are; ten thousand million of them fit their sum.
_FEW, _FEW_DIGITS = "decimal(18,6)", r"^[+-]?(?:\d{1,12}(?:\.\d{0,6})?|\.\d{1,6})$"


def _halves(text: Column) -> tuple[Column, Column]:
    """Any number as two decimals that add up exactly: before the point, and after it."""
    plain = F.when(F.regexp_like(text, F.lit("[eE]")), text.try_cast(V.DECIMAL).cast("string")).otherwise(text)
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    digits = F.translate(plain, "+-", "")
    whole = F.concat(sign, F.lit("0"), F.substring_index(digits, ".", 1)).try_cast("decimal(38,0)")
    after = F.when(F.contains(digits, F.lit(".")), F.substring_index(digits, ".", -1)).otherwise("")
    return whole, F.concat(sign, F.lit("0."), after, F.lit("0")).try_cast("decimal(38,28)")


def _totals(fields: DataFrame, names: Sequence[str], apart: Sequence[str] = (), ends: bool = True) -> DataFrame:
    """`(doc_id, _by)`: per document and name the count, sum, least and greatest of the fields the name stands for, as a map by name.

    Fields named in `apart` count under `=name` alone; without `ends` least and greatest are left null. Every document has a row. Numbers of few digits are summed at once;
    others are counted by their whole part first, so the least and greatest need no order over both parts.
    """
    keys = _matching(names)
    if apart:
        keys = F.when(F.col("name").isin(*apart), F.array(F.concat(F.lit("="), "name"))).otherwise(keys)
    rows = _numbers(fields).select("doc_id", "_t", F.explode_outer(keys).alias("_key"))
    rows = rows.withColumn("_long", ~F.regexp_like("_t", F.lit(_FEW_DIGITS)))
    whole, rest = _halves(F.col("_t"))
    rows = rows.select("doc_id", "_key", "_long", F.when(~F.col("_long"), F.col("_t").try_cast(_FEW)).alias("_v"),
                       F.when(F.col("_long"), whole).alias("_w"), F.when(F.col("_long"), rest).alias("_f"))
    end = lambda f, c: f(c) if ends else F.max(F.lit(None).cast("decimal(18,6)"))
    once = rows.groupBy("doc_id", "_key", "_long", "_w").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"), end(F.min, "_v").alias("_lo"), end(F.max, "_v").alias("_hi"),
        F.try_sum("_w").alias("_sw"), F.try_sum("_f").alias("_sf"), end(F.min, "_f").alias("_flo"), end(F.max, "_f").alias("_fhi"))
    lost = F.col("_w").isNotNull() & F.col("_sw").isNull()
    parts = once.repartition("doc_id").groupBy("doc_id", "_key").agg(
        F.sum("_n").alias("n"), F.sum("_s").alias("s"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.max("_long").alias("long"),
        F.try_sum("_sw").alias("w"), F.try_sum("_sf").alias("f"), F.max(lost).alias("_lost"), F.count("_w").alias("_ws"),
        F.max(F.col("_long") & F.col("_w").isNull()).alias("unread"),
        F.min("_w").alias("lo_w"), F.min_by("_flo", "_w").alias("lo_f"), F.max("_w").alias("hi_w"), F.max_by("_fhi", "_w").alias("hi_f"))
    over = F.col("_lost") | ((F.col("_ws") > 0) & F.col("w").isNull())
    far = F.struct(*[F.col(c).cast("string").alias(c) for c in ("w", "f", "lo_w", "lo_f", "hi_w", "hi_f")], over.alias("over"), F.col("unread"))
    text = lambda c: F.rtrim(F.rtrim(F.col(c).cast("string"), F.lit("0")), F.lit(".")).alias(c)
    part = F.struct("n", text("s"), text("lo"), text("hi"), F.when(F.col("long"), far).alias("far"))
    return parts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("_key").isNotNull(), F.struct("_key", part)))).alias("_by"))


# So many names are added up side by side; more of them go by rows, as the code made for a row must stay small enough to be compiled.
_BESIDE = 3
# Up to 9 digits before the point and 6 after it: in millionths a double holds them exactly.
_SHORT, _MILLIONTHS = r"^[+-]?(?:\d{1,9}(?:\.\d{0,6})?|\.\d{1,6})$", 6
# Millionths are added up in two pieces, longer numbers by groups of ten digits, 28 of all the digits after the point: nine hundred million long ones fit.
_BITS, _GROUP, _GROUPS, _AFTER = 30, 10, 7, 28


def _digits(text: Column) -> Column:
    """The digits of any number without its sign: four groups before the point, three for the `_AFTER` places after it; null where it is too long."""
    whole, rest = _halves(text)
    after = F.translate(F.format_number(rest, _AFTER), "-.", "")
    return F.concat(F.lpad(F.translate(whole.cast("string"), "-", ""), 4 * _GROUP, "0"), F.lpad(after, 3 * _GROUP, "0"))


def _sums(fields: DataFrame, names: Sequence[str], apart: Sequence[str], counted: Sequence[str]) -> DataFrame:
    """Per document one row with the count and sum of the fields each name stands for, side by side: `_p<i>_n`, and `_k` in millionths or `_s`, the pieces as text.

    Fields named in `apart` count under `=name` alone, those in `counted` without their sum. A document's fields are added up as whole
    numbers before they are moved and meet once. Only what is not a short number is read by its separators.
    """
    style = F.coalesce("separator_style", F.lit(0)) if "separator_style" in fields.columns else F.lit(0)
    t = F.trim("value")
    short = F.regexp_like(t, F.lit(_SHORT))
    own = F.col("name").isin(*apart) if apart else F.lit(False)
    meets = [~own & _under(n) for n in names] + [F.col("name") == m for m in apart]
    flags = [f"_m{i}" for i in range(len(meets))]
    rows = fields.select(
        "doc_id", F.rint(F.when(short, t.try_cast("double")) * 10**_MILLIONTHS).cast("long").alias("_v"),
        F.when(~short & (t != ""), V.number_text(F.col("value"), style)).alias("_t"), *[m.alias(f) for m, f in zip(meets, flags)])
    rows = rows.select("doc_id", "_v", F.when(F.col("_t").isNotNull(), _digits(F.col("_t"))).alias("_d"), F.when(F.col("_t").startswith("-"), -1).otherwise(1).alias("_sign"), *flags)
    groups = [(F.substring("_d", 1 + _GROUP * g, _GROUP).cast("long") * F.col("_sign")).alias(f"_g{g}") for g in range(_GROUPS)]
    rows = rows.select("doc_id", F.shiftright("_v", _BITS).alias("_hi"), F.col("_v").bitwiseAND((1 << _BITS) - 1).alias("_lo"), *groups, *flags)
    pieces = ["_hi", "_lo", *(f"_g{g}" for g in range(_GROUPS))]
    summed = [i for i in range(len(meets)) if i < len(names) or apart[i - len(names)] not in counted]
    found = rows.groupBy("doc_id").agg(
        *[F.count(F.when(F.col(m), 1)).alias(f"_n{i}") for i, m in enumerate(flags)],
        *[F.sum(F.when(F.col(flags[i]), F.col(c))).alias(f"{c}{i}") for i in summed for c in pieces])
    columns = []
    for i in range(len(meets)):
        there = F.col(f"_n{i}") > 0
        k, text = F.lit(0).cast("long"), F.lit(None).cast("string")
        if i in summed:
            few, most = [F.coalesce(f"{c}{i}", F.lit(0).cast("long")) for c in pieces[:2]], 1 << 28
            fits = F.col(f"_g0{i}").isNull() & few[0].between(-most, most)
            k = F.when(fits, few[0] * (1 << _BITS) + few[1])
            text = F.when(there & ~fits, F.concat_ws(",", *[F.coalesce(f"{c}{i}", F.lit(0).cast("long")) for c in pieces]))
        columns += [F.when(there, F.col(f"_n{i}")).alias(f"_p{i}_n"), F.when(there, k).alias(f"_p{i}_k"), text.alias(f"_p{i}_s")]
    return found.select("doc_id", *columns)


def _pieced(text: str) -> exact.Number:
    """The pieces of a sum put together, not yet fitted."""
    high, low, *groups = map(int, text.split(","))
    whole, after = (sum(n * 10 ** (_GROUP * i) for i, n in enumerate(reversed(part))) for part in (groups[:4], groups[4:]))
    return exact.joined(((high << _BITS) + low, _MILLIONTHS), (whole * 10**_AFTER + after, _AFTER))


# Count, sum (not yet rounded), least and greatest of some numbers; None in them is what does not fit.
_Part = tuple[int, exact.Number | None, exact.Number | None, exact.Number | None]


def _part(n: int | None, s: str | None, lo: str | None, hi: str | None, far: dict | None) -> _Part | None:
    if n is None:
        return None
    if far is None:
        return n, exact.plain(s), None if lo is None else exact.plain(lo), None if hi is None else exact.plain(hi)
    number = lambda w, f: None if w is None or f is None else exact.fitted(*exact.whole_and_rest(w, f))
    few = exact.plain(s or "0")
    total = None if far["over"] else exact.whole_and_rest(far["w"] or "0", far["f"] or "0", few)
    least = None if far["unread"] else _first([number(far["lo_w"], far["lo_f"]), exact.plain(lo) if lo else None], [far["lo_w"], lo], min)
    most = _first([number(far["hi_w"], far["hi_f"]), exact.plain(hi) if hi else None], [far["hi_w"], hi], max)
    return n, total, least, most


def _first(numbers: list, texts: list, pick) -> exact.Number | None:
    """The least or greatest of the numbers that are there; None where one that is there does not fit and comes first."""
    there = [(n, t) for n, t in zip(numbers, texts) if t is not None]
    if not there:
        return None
    size = lambda nt: exact.compared(nt[0]) if nt[0] is not None else exact.compared((int(nt[1].partition(".")[0]), 0))
    return pick(there, key=size)[0]


def _together(parts: Sequence[_Part | None]) -> _Part | None:
    """Several parts as one."""
    there = [p for p in parts if p is not None]
    if len(there) < 2:
        return there[0] if there else None
    n, total, least, most = there[0]
    for k, s, lo, hi in there[1:]:
        n, total = n + k, None if total is None or s is None else exact.joined(total, s)
        least = None if least is None or lo is None else min(least, lo, key=exact.compared)
        most = None if most is None or hi is None else max(most, hi, key=exact.compared)
    return n, total, least, most


def _folded(operation: str, part: _Part | None) -> exact.Number | None:
    """A part to the result of an operation."""
    if part is None:
        return exact.ZERO if operation in ("SUM", "AVG") else None
    n, total, least, most = part
    total = None if total is None else exact.fitted(*total)
    if operation == "AVG":
        return None if total is None else exact.divide(total, (n, 0))
    return total if operation == "SUM" else least if operation == "MIN" else most


_RESULT = "doc_id long, name string, text string"


def _with_number(results: DataFrame) -> DataFrame:
    """`text` is the exact result, `result` the same to ten places."""
    return results.select("doc_id", "name", F.col("text").try_cast(V.DECIMAL).alias("result"), "text")


def _apart(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """`_totals` with the part of each name as a column of its own, looked up once."""
    return totals.select("doc_id", *[F.try_element_at("_by", F.lit(n)).alias(f"_p{i}") for i, n in enumerate(names)])


_PART = "struct<n:bigint,s:string,lo:string,hi:string,far:struct<w:string,f:string,lo_w:string,lo_f:string,hi_w:string,hi_f:string,over:boolean,unread:boolean>>"


def _operation(c: Calculation, parts: Sequence[Column]) -> Column:
    """A calculation's result as text where it needs no rounding; else the parts it is made of."""
    none = reduce(lambda a, b: a & b, [p.isNull() for p in parts], F.lit(True))
    text = F.when(none, F.lit("0" if c.operation in ("SUM", "AVG") else None).cast("string"))
    known = none
    if len(parts) == 1 and c.operation != "AVG":
        known = none | parts[0]["far"].isNull()
        text = text.otherwise(parts[0][{"SUM": "s", "MIN": "lo", "MAX": "hi"}[c.operation]])
    return F.struct(
        F.lit(c.name).alias("name"), F.lit(c.operation).alias("_op"), F.when(known, text).alias("text"), (~known).alias("_open"),
        F.when(~known, F.array(*parts) if parts else F.array()).cast(f"array<{_PART}>").alias("_parts"))


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Averages, sums over several names and numbers of many digits to their results; the others are there already."""
    for batch in batches:
        rows = batch.select(["_op", "_parts"]).filter(batch["_open"])
        texts = []
        for op, parts in zip(rows["_op"].to_pylist(), rows["_parts"].to_pylist()):
            texts.append(exact.shown(_folded(op, _together([_part(**p) for p in parts]))))
        text = pc.replace_with_mask(batch["text"], batch["_open"], pa.array(texts, pa.string()))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "name": batch["name"], "text": text})


def calculate(fields: DataFrame, calculations: Sequence[Calculation]) -> DataFrame:
    """`(doc_id, name, result, text)` of every operation over the fields `(doc_id, name, value)` of each document.

    Empty and unreadable values count as 0. Without fields a sum and an average are 0, the others null; so is what
    overflows. Fields may have a `separator_style` of their own, and a `seq`, the order products are taken in (else by name).
    """
    ops = [c for c in calculations if c.operation]
    plain = [c for c in ops if c.operation != "PRD"]
    out: list[DataFrame] = []
    if plain:
        names = list(dict.fromkeys(f for c in plain for f in c.fields))
        made = [_operation(c, [F.col(f"_p{names.index(f)}") for f in c.fields]) for c in plain]
        every = _apart(_totals(fields, names), names).select("doc_id", F.explode(F.array(*made)).alias("_r")).select("doc_id", "_r.*")
        out.append(every.mapInArrow(_finished, _RESULT))
    products = [c for c in ops if c.operation == "PRD"]
    docs = fields.select("doc_id").distinct()
    if products:
        found = _named(fields, [(c.name, f) for c in products for f in c.fields])
        made = folds.product(found, ["doc_id", "target"], ["_place"], "_t", "text")
        out.append(_each(docs, [(c.name, "PRD") for c in products]).join(made, ["doc_id", "target"], "left").select("doc_id", F.col("target").alias("name"), "text"))
    if not out:
        return _with_number(docs.select("doc_id", F.lit("").alias("name"), F.lit(None).cast("string").alias("text")).limit(0))
    return _with_number(reduce(DataFrame.unionByName, out))


def derive(fields: DataFrame, name: str, expression: str) -> DataFrame:
    """`(doc_id, name, result, text)` of an expression of + - * / ( ), numbers and field names; null when it divides by zero.

    Each name is the sum of the fields it stands for. Every step is exact to 28 places or 96 bits (`functions/exactnumbers`).
    Raises ValueError where the text is no expression.
    """
    return _with_number(_in_turn(fields, [Calculation(name, expression=expression)]).select("doc_id", F.lit(name).alias("name"), F.col("_t0").alias("text")))


def _given(batch: pa.RecordBatch, at: int) -> list[_Part | None]:
    """The parts of one name, document by document."""
    own = {k: batch[name] for k in ("n", "k", "s", "lo", "hi", "far") if (name := f"_p{at}_{k}") in batch.schema.names}
    read = {k: [None] * batch.num_rows if c.null_count == batch.num_rows else c.to_pylist() for k, c in own.items()}
    if "k" in own:
        return [None if n is None else (n, (k, _MILLIONTHS) if t is None else _pieced(t), None, None) for n, k, t in zip(read["n"], read["k"], read["s"])]
    none = [None] * batch.num_rows
    return list(map(_part, read["n"], read["s"], read.get("lo", none), read.get("hi", none), read["far"]))


def _renewed(part: _Part | None, number: exact.Number | None) -> _Part | None:
    """Fields that have been given a result."""
    if part is None:
        return None
    n, value = part[0], number or exact.ZERO
    return n, value if n == 1 else exact.multiply(value, (n, 0)), value, value


def _in_turn(fields: DataFrame, calculations: Sequence[Calculation]) -> DataFrame:
    """`(doc_id, _t0, _t1, ...)`: the results of calculations without products as text, each seeing the results before it.

    A document comes as the totals of the names that are read, so its calculations are worked out one after the other on one row.
    """
    steps = [None if c.operation else exact.compiled(c.expression) for c in calculations]
    reads = [list(c.fields) if s is None else s.names for c, s in zip(calculations, steps)]
    names = list(dict.fromkeys(n for r in reads for n in r))
    # A result is seen by later calculations where the document has a field of that name.
    made = list(dict.fromkeys(c.name for c in calculations[:-1]))
    stands = {n: [m for m in made if m == n or m.startswith(n + ".")] for n in names}
    made = [m for m in made if any(m in ms for ms in stands.values())]
    columns = [*names, *("=" + m for m in made)]
    ends = any(c.operation in ("MIN", "MAX") for c in calculations)
    # What a field held counts only where something reads it before its own result is there.
    first = {m: [c.name for c in calculations].index(m) for m in made}
    counted = [m for m in made if not any(m in stands[n] for r in reads[: first[m] + 1] for n in r)]
    if ends or len(columns) - len(counted) > _BESIDE:
        kinds = ("n", "s", *(("lo", "hi") if ends else ()), "far")
        rows = _apart(_totals(fields, names, made, ends), columns).select("doc_id", *[F.col(f"_p{i}.{k}").alias(f"_p{i}_{k}") for i in range(len(columns)) for k in kinds])
    else:
        rows = _sums(fields, names, made, counted)
    schema = ", ".join(["doc_id long", *(f"_t{i} string" for i in range(len(calculations)))])

    def at_once(batch: pa.RecordBatch) -> dict | None:
        """Sums and expressions over all documents of a batch as 64-bit whole numbers; None where those do not do."""
        if any(f"_p{at}_k" not in batch.schema.names or batch[f"_p{at}_s"].null_count < batch.num_rows for at in range(len(columns))):
            return None
        filled = lambda at, k: pc.fill_null(batch[f"_p{at}_{k}"], 0).to_numpy(zero_copy_only=False)
        total = {n: exact.Vector.of(filled(at, "k"), _MILLIONTHS) for at, n in enumerate(columns)}
        now = {m: total["=" + m] for m in made}
        out = {"doc_id": batch["doc_id"]}
        for at, (c, s, r) in enumerate(zip(calculations, steps, reads)):
            own = {n: exact.Vector.added([total[n], *[now[m] for m in stands[n]]]) for n in r}
            if any(v is None for v in own.values()) or s is None and (c.operation != "SUM" or not c.fields):
                return None
            found = exact.Vector.added([own[n] for n in c.fields]) if s is None else s(own, batch.num_rows)
            if c.name in now:
                times = exact.Vector(filled(columns.index("=" + c.name), "n"), 0)
                now[c.name] = found.times(times) if isinstance(found, exact.Vector) else None
                if now[c.name] is None:
                    return None
            if found is None:
                return None
            out[f"_t{at}"] = found.shown() if isinstance(found, exact.Vector) else pa.array(map(exact.shown, found), pa.string())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quick = at_once(batch)
            if quick is not None:
                yield pa.RecordBatch.from_pydict(quick)
                continue
            given = {n: _given(batch, at) for at, n in enumerate(columns)}
            now = {m: given["=" + m] for m in made}
            out = {"doc_id": batch["doc_id"]}
            for at, (c, s, r) in enumerate(zip(calculations, steps, reads)):
                parts = {n: list(map(_together, zip(given[n], *[now[m] for m in stands[n]]))) if stands[n] else given[n] for n in r}
                if s is not None:
                    numbers = s({n: [exact.ZERO if p is None else p[1] and exact.fitted(*p[1]) for p in own] for n, own in parts.items()}, batch.num_rows)
                    numbers = numbers.numbers() if isinstance(numbers, exact.Vector) else numbers
                elif len(c.fields) == 1:
                    numbers = [_folded(c.operation, p) for p in parts[c.fields[0]]]
                else:
                    several = zip(*[parts[n] for n in c.fields]) if c.fields else [()] * batch.num_rows
                    numbers = [_folded(c.operation, _together(ps)) for ps in several]
                out[f"_t{at}"] = pa.array(map(exact.shown, numbers), pa.string())
                if c.name in now:
                    now[c.name] = list(map(_renewed, now[c.name], numbers))
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, schema)


def recalculate(fields: DataFrame, calculations: Sequence[Calculation]) -> DataFrame:
    """Every calculated field in the order given, each seeing the results before it; the changed ones with their new value.

    Calculations follow each other on a document's row until a product, or a name calculated again, needs the fields anew.
    """
    rounds: list[list[Calculation]] = []
    for c in calculations:
        product = c.operation == "PRD"
        if not rounds or product or rounds[-1][0].operation == "PRD" or c.name in {m.name for m in rounds[-1]}:
            rounds.append([])
        rounds[-1].append(c)
    more = [c for c in ("separator_style", "seq") if c in fields.columns]
    current = fields.select("doc_id", "name", "value", F.coalesce("value", F.lit("")).alias("_old"), *more)
    for at, batch in enumerate(rounds, 1):
        product = batch[0].operation == "PRD"
        new = calculate(current, batch) if product else _in_turn(current, batch)
        if at == len(rounds):  # what no calculation names cannot have changed
            current = current.where(F.col("name").isin(*{c.name for c in calculations}))
        if product:
            new = new.select("doc_id", "name", F.coalesce("text", F.lit("")).alias("_new"))
            current, value = current.join(new, ["doc_id", "name"], "left"), F.coalesce("_new", "value")
        else:  # a document's results are one row
            current = current.join(new.withColumn("_made", F.lit(True)), "doc_id", "left")
            value = reduce(lambda v, i: F.when(F.col("_made") & (F.col("name") == batch[i].name), F.coalesce(f"_t{i}", F.lit(""))).otherwise(v), range(len(batch)), F.col("value"))
        current = current.select("doc_id", "name", value.alias("value"), "_old", *more)
        current = current if at == len(rounds) else cut(current)
    return current.where("value <> _old").select("doc_id", "name", "value")


def import_values(fields: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields `(doc_id, name, value, read_only)` with incoming `(doc_id, name, value, seq)` put in, and what became of each.

    The last value for a field counts. Unknown and read-only fields are left alone and listed; so are
    values that are too long and documents with too many changes.
    """
    last = incoming.groupBy("doc_id", "name").agg(F.max_by("value", "seq").alias("_new"))
    matched = last.join(fields.select("doc_id", "name", "read_only"), ["doc_id", "name"], "left")
    many = matched.where("read_only = false").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > MAX_CHANGES).select("doc_id", F.lit(True).alias("_many"))
    status = (
        F.when(F.col("read_only").isNull(), "unknown").when(F.col("read_only"), "read-only").when(F.length("_new") > MAX_CHARACTERS, "too long")
        .when(F.coalesce("_many", F.lit(False)), "too many").otherwise("changed"))
    report = matched.join(many, "doc_id", "left").select("doc_id", "name", "_new", status.alias("status"))
    changes = report.where("status = 'changed'").select("doc_id", "name", "_new")
    updated = fields.join(changes, ["doc_id", "name"], "left").withColumn("value", F.coalesce("_new", "value")).select(*fields.columns)
    return updated, report.drop("_new")


def reset(fields: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Values back to their defaults, of all fields or of those named in `only (name)`; read-only ones stay."""
    back = F.when(F.col("read_only"), F.col("value")).otherwise(F.coalesce("default_value", F.lit("")))
    if only is None:
        return fields.withColumn("value", back)
    named = sizes.small(only.select("name").distinct().withColumn("_named", F.lit(True)))
    marked = fields.join(named, "name", "left")
    return marked.withColumn("value", F.when(F.col("_named"), back).otherwise(F.col("value"))).select(*fields.columns)
