"""Secret scan by a trigram index, in DataFrame functions only.

Each rule's regex gives a Boolean trigram query (`trigram_query`): clauses that must all hold, each an OR over literal
strings, each string an AND over its trigrams. The index is bit-sliced: one bit per trigram that some query names, per
row, so a posting list is the set of rows with that bit and intersecting lists is an AND of bits. A rule looks for its
regex only in rows whose bits satisfy its query; a rule whose regex has no mandatory trigram scans every row.
There is no shuffle, no join and no Python in the plan, so hot keys and lost executors cost one task's rescan at most.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` 0 or the capturing group whose length must be `least` or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


# The base rules as stated, in the order in which ties sort.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Public formats of well-known credentials, which the scan adds to the base rules.
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


def _spread(string: str) -> list[str]:
    """Up to three trigrams of a string, its ends and middle: fewer lists to intersect, and still all mandatory."""
    last = len(string) - 3
    return sorted({string[i : i + 3] for i in (0, last // 2, last)})


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """The mandatory trigrams of a regex: an AND of clauses, each an OR of strings, each the list of its trigrams
    (up to three, spread over it).

    Letters are folded to lower case, as the index is. A clause is kept only if all its strings have trigrams; an empty
    result says that the regex has no mandatory trigram.
    """
    clauses: list[list[list[str]]] = []

    def flush(strings: set[str]) -> set[str]:
        if strings and min(map(len, strings)) >= 3:
            clauses.append([_spread(s) for s in sorted(strings)])
        return {""}

    def cross(left: set[str], right: set[str] | None) -> set[str]:
        if right is None or len(left) * len(right) > MOST_STRINGS:
            flush(left)
            return right if right is not None and len(right) <= MOST_STRINGS else {""}
        return {a + b for a in left for b in right}

    def exact(items) -> set[str] | None:
        """All strings that the items can match, or None if they are too many to list."""
        out = {""}
        for op, arg in items:
            if op is C.LITERAL:
                part: set[str] | None = {chr(arg).lower()}
            elif op is C.SUBPATTERN:
                part = exact(arg[3])
            elif op is C.BRANCH:
                parts = [exact(x) for x in arg[1]]
                part = None if any(x is None for x in parts) else set().union(*parts)
            elif op is C.MAX_REPEAT and arg[1] == 1:
                one = exact(arg[2])
                part = None if one is None else one | ({""} if arg[0] == 0 else set())
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
                part = {chr(v).lower() for _, v in arg}
            else:
                part = None
            if part is None or len(out) * len(part) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in part}
        return out

    current = {""}
    for item in parser.parse(pattern):
        if item[0] is not C.LITERAL and min(map(len, current)) >= 3:
            current = flush(current)
        current = cross(current, exact([item]))
    flush(current)
    return clauses


def _postings(lowered: Column, trigrams: list[str]) -> Column:
    """Bits of the trigrams that a text holds, 62 to a word."""
    words = []
    for i in range(0, len(trigrams), 62):
        bits = [F.when(F.contains(lowered, F.lit(t)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, t in enumerate(trigrams[i : i + 62])]
        total = bits[0]
        for b in bits[1:]:
            total = total.bitwiseOR(b)
        words.append(total)
    return F.array(*words)


def _holds(bits: Column, query: list[list[list[str]]], trigrams: list[str]) -> Column:
    """The Boolean query over the bits: lists are intersected within a string, united over a clause's strings."""
    at = {t: divmod(i, 62) for i, t in enumerate(trigrams)}
    whole = F.lit(True)
    for clause in query:
        any_of = F.lit(False)
        for string in clause:
            masks: dict[int, int] = {}
            for t in string:
                masks[at[t][0]] = masks.get(at[t][0], 0) | 1 << at[t][1]
            one = F.lit(True)
            for word, mask in masks.items():
                m = F.lit(mask).cast("long")
                one = one & (F.element_at(bits, word + 1).bitwiseAND(m) == m)
            any_of = any_of | one
        whole = whole & any_of
    return whole


#: Elements of an array that one fold goes over at least; longer arrays are folded in blocks of about their root.
BLOCK = 64
SPAN = "struct<start:int,kind:int,end:int>"


def _bound(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _blocks(rows: Column, total, merge, body) -> Column:
    """For each block of an array in order `body(block, before)`: `before` is what `merge` makes of the `total`s of the blocks before.

    A fold that appends copies what it has; over blocks of about the root of the length that is n ** 1.5 in all.
    """
    width = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(rows).cast("double"))).cast("int"))

    def split(n: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / n).cast("int")), lambda i: F.slice(rows, i * n + 1, n))
        return _bound(parts, lambda p: _bound(F.aggregate(F.slice(p, 1, F.size(p) - 1), F.array(F.lit(0)), lambda a, block: F.concat(a, F.array(merge(F.element_at(a, -1), total(block))))), lambda before: F.zip_with(p, before, body)))

    return F.when(F.size(rows) > 0, _bound(width, split))


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end) in code points, failing ones dropped.

    The pieces between matches and the matches add up to the text, so running lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else whole
    pieces = F.split(text, rule.java, -1)
    rows = F.zip_with(F.slice(pieces, 1, F.size(whole)), F.zip_with(whole, checked, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))), lambda p, x: F.struct(F.length(p).alias("p"), x["m"].alias("m"), x["g"].alias("g")))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["p"]
        end = begin + x["m"]
        found = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["g"] >= rule.least, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def inside(block: Column, before: Column) -> Column:
        return F.aggregate(block, F.struct(before.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    length = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["p"] + x["m"])
    return _bound(rows, lambda r: F.coalesce(F.flatten(_blocks(r, length, lambda a, n: a + n, inside)), empty))


def _maximal(rule: Rule) -> Rule:
    """The length bound inside the regex, where that cannot change the result: a run of one class, after a fixed prefix.

    The class holds the prefix's own characters, so a run that is too short from its first start is so from any later one.
    """
    if rule.group == 0 and rule.least:
        m = re.fullmatch(r"([A-Z]*)(\[[^\]]+\])\+", rule.pattern)
        if m:
            return Rule(rule.kind, f"{m[1]}{m[2]}{{{rule.least - len(m[1])},}}", 0, 0, rule.ignore_case)
    return rule


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, name: str = "secret_spans") -> DataFrame:
    """Add a column `name`, an array of (start, kind, end) sorted by start, then by the order of `rules`.

    Places are code points of the whole text, the end exclusive. A null or empty text has no spans; a text is scanned whole
    by one task, however long; repeated rows are scanned each; an empty table stays empty. Other columns pass through; a
    column called `name` is replaced. Matches of different kinds may overlap.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for c in q for s in c for t in s})
    none = F.array().cast(f"array<{SPAN}>")
    low, bits = unused(docs, "low"), unused(docs, "bits")
    with_bits = docs.withColumn(low, F.lower(body)).withColumn(bits, _postings(F.col(low), trigrams)).drop(low)
    found = []
    for k, (rule, query) in enumerate(zip(rules, queries)):
        spans = _spans(body, _maximal(rule), k)
        found.append(F.when(_holds(F.col(bits), query, trigrams), spans).otherwise(none) if query else spans)
    return with_bits.withColumn(name, F.array_sort(F.concat(*found))).drop(bits)


def spans_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + ADDED_RULES, mark: str = "[SECRET]") -> DataFrame:
    """Replace every span, overlapping and adjoining ones merged, by `mark`.

    Null texts stay null; rows without spans stay as they are; repeated rows are redacted each; an empty table stays empty.
    A text is put together whole, however long; other columns pass through, whatever they are called.
    """
    spans = unused(docs, "spans")
    scanned = scan(docs, text, rules, spans)

    def inside(block: Column, before: Column) -> Column:
        last = F.aggregate(block, before, lambda a, s: F.greatest(a, s["end"]))
        start = F.struct(before.alias("at"), F.array().cast("array<string>").alias("out"))

        def cut(part: Column) -> Column:  # the text of this block's spans alone, so that places in it are near
            def step(acc: Column, s: Column) -> Column:
                gap = F.substring(part, acc["at"] - before + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
                fresh = (s["start"] >= acc["at"]) & ~((s["start"] == acc["at"]) & (acc["at"] > 0))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

            return F.array_join(F.aggregate(block, start, step, lambda acc: acc["out"]), "")

        return _bound(F.substring(F.col(text), before + 1, last - before), cut)

    ends = lambda block: F.aggregate(block, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    last = ends(F.col(spans))
    clean = F.concat(F.array_join(_blocks(F.col(spans), ends, lambda a, n: F.greatest(a, n), inside), ""), F.substring(F.col(text), last + 1, F.length(text)))
    return scanned.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).drop(spans)


def query(spark, sf_dir: str) -> DataFrame:
    """`op10_secret_scan`: the base kinds counted and digested, and all spans, of every document."""
    from .common import table

    rules = BASE_RULES + ADDED_RULES
    base = F.filter(F.col("secret_spans"), lambda s: s["kind"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter(F.col("secret_spans"), lambda s: s["kind"] == k)).cast("long")
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", rules).select("doc_id", "secret_spans")
    return out.select("doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)], F.sha2(spans_text(base, rules).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secret_spans"), rules).alias("spans"))


#: The same for the base kinds, in DuckDB; spans also holds what the added rules find, of which its regexes are these.
def _duck() -> str:
    rules = BASE_RULES + ADDED_RULES
    parts = []
    for k, r in enumerate(rules):
        p = _maximal(r)
        rx = (("(?i)" if p.ignore_case else "") + p.pattern).replace("'", "''")
        need = f"len(regexp_extract(m[i], '^{rx}$', {p.group})) >= {p.least}" if p.group else "true"
        parts.append(
            f"SELECT doc_id, x.s AS s, {k} AS k, x.e AS e, '{r.kind}' AS kind FROM (SELECT doc_id, unnest([{{'s': (list_sum([length(y) for y in p[1:i]]) + coalesce(list_sum([length(y) for y in m[1:i - 1]]), 0))::BIGINT,"
            f" 'e': (list_sum([length(y) for y in p[1:i]]) + list_sum([length(y) for y in m[1:i]]))::BIGINT, 'ok': {need}}} for i in range(1, len(m) + 1)]) AS x"
            f" FROM (SELECT doc_id, regexp_extract_all(t, '{rx}') AS m, regexp_split_to_array(t, '{rx}') AS p FROM d)) WHERE x.ok"
        )
    base = len(BASE_RULES)
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(parts) + "), g AS (SELECT doc_id,"
        + "".join(f" count(*) FILTER (WHERE k = {k}) AS n_{r.kind}," for k, r in enumerate(BASE_RULES))
        + f" string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < {base}) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)"
        " SELECT d.doc_id," + "".join(f" coalesce(n_{r.kind}, 0) AS n_{r.kind}," for r in BASE_RULES) + " sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"
    )


ORACLE_SQL = _duck()
