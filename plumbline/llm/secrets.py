"""Secrets in texts, found through an inverted index of trigrams.

Every rule is a regular expression, from which a Boolean query over trigrams is derived that any match
must fulfil. The postings of those trigrams are written once per corpus; intersecting them gives the
candidates of a rule, and only candidates are verified with the expression itself. A rule without
mandatory trigrams scans all texts. Everything on the data is a built-in function.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import hold

#: Strings that a stretch of an expression may stand for before it is taken apart into trigrams.
EXACT = 16


@dataclass(frozen=True)
class Rule:
    """An expression in the syntax that Python and Java share. A match shorter than ``least`` code points
    in group ``group`` (0: all of it) is no finding, but is not searched again. Without mandatory
    trigrams ``scan`` may name an expression that every finding contains."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    scan: str | None = None


# Forms of secrets, the three given ones first.
GIVEN = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24, scan=r"[0-9a-f]{24}"),
)
MORE = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{9,}\.eyJ[A-Za-z0-9_-]{9,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A query: all of the clauses hold; a clause holds if all trigrams of one of its alternatives are there.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """Clauses over lower-case trigrams that hold in the lower-case text of every match; none if nothing is mandatory."""
    clauses: Query = []
    last = _walk(parser.parse(pattern), clauses, {""})
    _settle(last, clauses)
    return clauses


def _settle(strings: set[str], clauses: Query) -> None:
    """Turn the strings one of which must occur into a clause."""
    options = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]
    if all(options):
        clauses.append(list(dict.fromkeys(options)))


def _walk(nodes, clauses: Query, strings: set[str]) -> set[str]:
    """Extend the strings that may have ended here by a sequence of syntax nodes."""
    for node in nodes:
        more = _strings(node)
        if more is not None and len(strings) * len(more) <= EXACT:
            strings = {a + b for a, b in product(strings, more)}
            continue
        _settle(strings, clauses)
        op, value = node
        strings = more if more is not None else {""}
        if op is ops.SUBPATTERN:
            strings = _walk(value[3], clauses, {""})
        elif op is ops.BRANCH:
            parts = []
            for branch in value[1]:
                inner: Query = []
                _settle(_walk(branch, inner, {""}), inner)
                parts.append(inner)
            if all(parts):  # one alternative per branch and choice within it; else nothing is mandatory
                clauses.append([frozenset().union(*choice) for inner in parts for choice in product(*inner)])
        elif op is ops.MAX_REPEAT and value[0] > 0 and more is None:
            _settle(_walk(value[2], clauses, {""}), clauses)
    return strings


def _strings(node) -> set[str] | None:
    """All lower-case strings a node stands for, if they are few; None otherwise."""
    op, value = node
    if op is ops.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if op is ops.IN and all(x is ops.LITERAL and y < 128 for x, y in value):
        return {chr(y).lower() for _, y in value} if len(value) <= EXACT else None
    if op is ops.SUBPATTERN:
        return _all_strings(value[3])
    if op is ops.BRANCH:
        parts = [_all_strings(b) for b in value[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op is ops.MAX_REPEAT and value[1] <= 1:
        inner = _all_strings(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _all_strings(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(found) * len(more) > EXACT:
            return None
        found = {a + b for a, b in product(found, more)}
    return found


def _identity(key: str, text: Column) -> list[Column]:
    return [quoted(key).alias("__key"), F.xxhash64(text).alias("__digest"), F.length(text).alias("__chars")]


def index(docs: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, __key, __digest, __chars): which texts hold which of the trigrams the rules ask for.

    A rule that must scan has postings too, under its kind in brackets. Rows are told apart by key and
    text, so equal rows repeat their postings; a null text is empty.
    """
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for option in clause for g in option})
    body = F.coalesce(quoted(text), F.lit(""))
    given = docs.select(*_identity(key, body), body.alias("t"), F.lower(body).alias("low"))
    found = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]
    found += [F.when(F.col("t").rlike(r.scan or r.pattern), F.lit(f"[{r.kind}]"))
              for r in rules if not trigram_query(r.pattern)]
    return given.select(F.explode(F.array_compact(F.array(*found))).alias("gram"), "__key", "__digest", "__chars")


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(__key, __digest, __chars, kinds): texts that fulfil the trigram query of a rule, by intersecting postings."""
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for option in clause for g in option}
                   | {f"[{r.kind}]" for r in rules})
    words = len(grams) // 63 + 1
    place = {g: divmod(i, 63) for i, g in enumerate(grams)}
    bit = F.create_map(*[x for g in grams for x in (F.lit(g), F.lit(1 << place[g][1]))])
    word = F.create_map(*[x for g in grams for x in (F.lit(g), F.lit(place[g][0]))])
    coded = postings.select("__key", "__digest", "__chars", bit[F.col("gram")].alias("bit"), word[F.col("gram")].alias("word"))
    sets = coded.groupBy("__key", "__digest", "__chars").agg(*[
        F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0))).alias(f"set{i}") for i in range(words)])

    def holds(option) -> Column:
        wanted = [0] * words
        for g in option:
            wanted[place[g][0]] |= 1 << place[g][1]
        tests = [F.col(f"set{i}").bitwiseAND(F.lit(w)) == F.lit(w) for i, w in enumerate(wanted) if w]
        return _all(tests, True)

    def matches(rule: Rule) -> Column:
        query = trigram_query(rule.pattern) or [[frozenset([f"[{rule.kind}]"])]]
        return _all([_all([holds(o) for o in clause], False) for clause in query], True)

    kinds = F.array_compact(F.array(*[F.when(matches(r), F.lit(r.kind)) for r in rules]))
    return sets.select("__key", "__digest", "__chars", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _all(tests: list[Column], every: bool) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t if every else out | t
    return out


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points of the findings of a rule, from what lies between its matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    pieces = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), whole, lambda a, b: F.struct(
        F.length(a).alias("gap"), F.length(b).alias("size")))
    pieces = F.zip_with(pieces, part, lambda p, g: F.struct(
        p["gap"].alias("gap"), p["size"].alias("size"), (F.length(g) >= rule.least).alias("found")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(pieces, start, lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + p["size"]).alias("at"),
        F.when(p["found"], F.array_append(acc["spans"], F.struct(
            (acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["size"]).alias("end"))))
        .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = (*GIVEN, *MORE)) -> DataFrame:
    """(key, findings): per row of ``docs`` the findings as structs (start, rank, kind, end) in that order.

    ``rank`` is the place of the rule. Per rule matches are leftmost and do not overlap. Null and empty
    texts have none; repeated rows each get theirs; null keys are kept.
    """
    body = F.coalesce(quoted(text), F.lit(""))
    wanted = hold(candidates(hold(index(docs, rules, key, text)), rules))
    same = ["__digest", "__chars"]
    texts = docs.select(*_identity(key, body), body.alias("t"))
    held = texts.alias("a").join(wanted.alias("b"), _same_row("a", "b"), "inner")
    # Matches of the candidate kinds only; the arrays of the others stay empty without a search.
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    lists = [F.when(F.array_contains("b.kinds", r.kind), F.transform(_spans(F.col("t"), r), _ranked(i, r.kind))).otherwise(none)
             for i, r in enumerate(rules)]
    verified = held.select(F.col("a.__key").alias("__key"), *[F.col(f"a.{c}").alias(c) for c in same],
                           F.array_sort(F.flatten(F.array(*lists))).alias("findings")).filter(F.size("findings") > 0)
    found = hold(verified.groupBy("__key", *same).agg(F.first("findings").alias("findings")))
    rows = docs.select(quoted(key).alias(key), *_identity(key, body))
    return rows.alias("a").join(found.alias("b"), _same_row("a", "b"), "left").select(
        F.col(f"a.`{key}`").alias(key), F.coalesce("findings", none).alias("findings"))


def _ranked(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _same_row(a: str, b: str) -> Column:
    return (F.col(f"{a}.__digest") == F.col(f"{b}.__digest")) & F.col(f"{a}.__key").eqNullSafe(F.col(f"{b}.__key")) & (
        F.col(f"{a}.__chars") == F.col(f"{b}.__chars"))


def joined(findings: Column, kinds: Sequence[str] | None = None) -> Column:
    """"kind:start:end" of the findings, in their order, joined by commas."""
    chosen = findings if kinds is None else F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def count_kind(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")
