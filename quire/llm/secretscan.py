"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: what every match must contain. The index holds
postings (trigram, row) of the lower-cased texts, for the trigrams that the rules ask for. Postings are intersected per
alternative of a query, the candidates are verified with the pattern, and rules without a mandatory trigram scan all.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common, rowspans

# Strings followed at a time through a pattern, and alternatives kept of a query; beyond, the query is made weaker.
MOST = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # read alike by Java, RE2 and Python
    group: int = 0  # what must be at least `least` code points long
    least: int = 1
    base: bool = True


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


WORDS = ("password", "passwd", "secret", "token", "api_?key")
RULES = (
    Rule("assign", f"({'|'.join(map(_either, WORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    # Runs shorter than 16 fail anyway, so only longer ones are matched.
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", base=False),
    Rule("code_host", "gh[oprsu]_[A-Za-z0-9]+", 0, 40, base=False),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 15, base=False),
)


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Alternatives of trigrams, in lower case: a text that matches holds all trigrams of one of them. An alternative
    without trigrams stands for any text."""
    clauses: list[frozenset[frozenset[str]]] = []

    def of(strings: set[str]) -> frozenset[frozenset[str]]:
        return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})

    def exact(nodes) -> set[str] | None:
        """All strings that the nodes match, where they are few."""
        held = {""}
        for op, value in nodes:
            step = one(op, value)
            if step is None or len(held) * len(step) > MOST:
                return None
            held = {a + b for a in held for b in step}
        return held

    def one(op, value) -> set[str] | None:
        if op is sre.LITERAL:
            return {chr(value).lower()}
        if op is sre.IN:
            found: set[str] = set()
            for kind, v in value:
                if kind is sre.LITERAL:
                    found.add(chr(v).lower())
                elif kind is sre.RANGE and v[1] - v[0] < MOST:
                    found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    return None
            return found if len(found) <= 8 else None
        if op is sre.SUBPATTERN:
            return exact(value[-1])
        if op is sre.BRANCH:
            parts = [exact(branch) for branch in value[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is sre.MAX_REPEAT and value[1] == 1:
            inner = exact(value[2])
            return None if inner is None else inner | ({""} if value[0] == 0 else set())
        return {""} if op is sre.AT else None

    def walk(nodes) -> None:
        held = {""}
        for op, value in nodes:
            step = one(op, value)
            if step is not None and len(held) * len(step) <= MOST:
                held = {a + b for a in held for b in step}
                continue
            inner = exact(value[2]) if op is sre.MAX_REPEAT and value[0] > 0 else None
            if inner is not None and len(held) * len(inner) <= MOST:
                clauses.append(of({a + b for a in held for b in inner}))  # the first time round
                held = inner  # and the last
                continue
            clauses.append(of(held))
            held = {""}
            if op is sre.SUBPATTERN:
                walk(value[-1])
            elif op is sre.MAX_REPEAT and value[0] > 0:
                walk(value[2])
            elif op is sre.BRANCH:
                clauses.append(_least(set().union(*(_of_nodes(branch) for branch in value[1]))))
        clauses.append(of(held))

    def _of_nodes(nodes) -> frozenset[frozenset[str]]:
        outer = clauses.copy()
        clauses.clear()
        walk(nodes)
        found = _all(clauses)
        clauses[:] = outer
        return found

    return _of_nodes(sre_parser.parse(pattern))


def _least(alternatives) -> frozenset[frozenset[str]]:
    """Without alternatives that another one already covers."""
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _all(clauses) -> frozenset[frozenset[str]]:
    held: frozenset[frozenset[str]] = frozenset({frozenset()})
    for clause in sorted(clauses, key=len):
        if len(held) * len(clause) <= MOST:
            held = _least({a | b for a in held for b in clause})
    return held


def plan(rules: tuple[Rule, ...]) -> list[tuple[str, int, str, int]]:
    """(kind, alternative, trigram, trigrams of that alternative) for rules that need trigrams."""
    rows = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if frozenset() not in query:
            for k, alternative in enumerate(sorted(query, key=sorted)):
                rows += [(rule.kind, k, t, len(alternative)) for t in sorted(alternative)]
    return rows


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: `(trigram, key)` for each of the trigrams that the lower-cased text of `(key, text)` holds."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return rows.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`(key, kinds)`: the rules of which some alternative has all its trigrams in the row."""
    # The plan comes from the caller's own rules, so its size is known.
    wanted = F.broadcast(index.sparkSession.createDataFrame(plan(rules), "kind string, alternative int, trigram string, needed int"))
    met = index.join(wanted, "trigram").groupBy("key", "kind", "alternative").agg(F.countDistinct("trigram").alias("n"), F.first("needed").alias("needed"))
    return met.where("n = needed").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """A rule's matches in a text as an array of (start, order, end, kind)."""
    found = rowspans.matches(text, rule.pattern)
    kind = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"
    shown = lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), m["end"].alias("end"), F.lit(rule.kind).alias("kind"))
    if rule.group:
        value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        both = F.zip_with(found, value, lambda m, v: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.char_length(v).alias("n")))
        return F.transform(F.filter(both, lambda m: m["n"] >= rule.least), shown).cast(kind)
    return F.transform(F.filter(found, lambda m: m["end"] - m["start"] >= rule.least), shown).cast(kind)


def found(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *keep: str) -> DataFrame:
    """Every row's secrets: `(doc_id, spans)` and, if asked for, its text; an array of (start, ord, end, kind) by start and then by order of the rules.

    Candidates come back to their texts through a key over (doc_id, text), so rows that agree in both share results and
    each keeps its own row. A null or empty text has no spans; a null id is an id like any other; an empty table gives an
    empty one; other columns stay behind.
    """
    rows = common.texts(docs).withColumn("key", common.row_key())
    wanted = plan(rules)
    indexed = {kind for kind, *_ in wanted}
    index = common.staged(postings(rows, sorted({t for _, _, t, _ in wanted})), "postings")
    joined = rows.join(candidates(index, rules), "key", "left")
    nothing = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>")
    parts = []
    for order, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, order)
        if rule.kind in indexed:
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(nothing)
        parts.append(spans)
    return joined.select("doc_id", *keep, F.sort_array(F.flatten(F.array(*parts))).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`(doc_id, text)` with each secret replaced by `[kind]`; of spans that overlap the first names the place."""
    whole = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        out = F.when(s["start"] >= done["at"], F.concat(done["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    def close(done: Column) -> Column:
        return F.concat(done["out"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.char_length("text")))

    return found(docs, rules, "text").select("doc_id", F.aggregate("spans", whole, step, close).alias("text"))


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row the number of base spans of each kind, the SHA-256 of their list and the list of all spans."""
    base = [(i, r) for i, r in enumerate(rules) if r.base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("bigint")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in base]
    of_base = F.filter("spans", lambda s: s["ord"].isin([i for i, _ in base]))
    return found(docs, rules).select("doc_id", *counts, F.sha2(text(of_base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def digest_sql(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for order, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT k, {order} AS ord, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, unnest(range(1, len(m) + 1)) AS i, m, g, v
            FROM (SELECT k, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', {rule.group}) AS v FROM d)
            WHERE len(m) > 0""")
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (WHERE ord = {i}) AS n_{r.kind}" for i, r in enumerate(rules) if r.base)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT k, ord, kind, base, length(v[i]) AS n, length(m[i]) AS len,
    coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM hits),
kept AS (SELECT *, kind || ':' || start::BIGINT || ':' || (start + len)::BIGINT AS s FROM placed WHERE n >= CASE ord {least} END),
rows AS (SELECT k, {counts}, string_agg(s, ',' ORDER BY start, ord) FILTER (WHERE base) AS b, string_agg(s, ',' ORDER BY start, ord) AS spans FROM kept GROUP BY k)
SELECT doc_id, {names}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN rows USING (k)
"""
