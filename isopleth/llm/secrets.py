"""Secret scans: candidates from a trigram index, verified by the rules' own expressions."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.llm.text import let, text_or_empty
from isopleth.session import pinned

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Kinds that every scan reports.  The quantifiers of access and hex hold their
#: minimum: a maximal run that is too short has no later start that is long enough.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Formats of further issuers.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: Strings that one stretch of an expression may stand for before it counts as free.
MOST_STRINGS = 64


def _strings(node) -> set[str] | None:
    """All strings an item can match, in lower case; None if they are too many."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS // 4:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= MOST_STRINGS // 4 else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence_strings(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        one = _sequence_strings(inner)
        if one is None or high is sre.MAXREPEAT or len(one) ** int(high) > MOST_STRINGS:
            return None
        return {"".join(p) for n in range(low, int(high) + 1) for p in itertools.product(sorted(one), repeat=n)}
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What every match contains, in lower case: an AND of ORs of ANDs of trigrams.

    Each stretch of the expression between free parts stands for a few strings;
    one of them must occur, hence all trigrams of one of them.  A stretch with
    a string below three characters says nothing.  An empty result means that
    the expression has no mandatory trigrams.
    """
    clauses: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in sets:
            least = [s for s in sets if not any(t < s for t in sets)]
            clauses.append(sorted(least, key=sorted))

    def walk(items) -> None:
        held = {""}
        for item in items:
            op, arg = item
            more = _strings(item)
            if more is not None and len(held) * len(more) <= MOST_STRINGS:
                held = {a + b for a in held for b in more}
                continue
            flush(held)
            held = {""}
            if more is not None:
                held = more
            elif op is sre.SUBPATTERN:
                walk(arg[-1])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        flush(held)

    walk(sre_parse.parse(pattern))
    return clauses


def postings(docs: DataFrame, text: Column, grams: Sequence[str]) -> DataFrame:
    """The inverted index of the trigrams that rules ask for: gram, _h (hash of the text).

    Copies of a text are one entry.  Equal hashes of different texts only add
    candidates, which verification drops.
    """
    listed = F.array(*[F.lit(g) for g in grams])
    found = let(F.lower(text), lambda low: F.filter(listed, lambda g: F.contains(low, g)))
    per_text = docs.select(F.xxhash64(text).alias("_h"), found.alias("_g")).where(F.size("_g") > 0)
    return per_text.dropDuplicates(["_h"]).select(F.explode("_g").alias("gram"), "_h")


def candidates(index: DataFrame, queries: dict[str, list[list[frozenset[str]]]]) -> DataFrame:
    """Texts that satisfy a rule's query, by intersecting postings: _h and the array _kinds.

    The table of queries has a row per trigram of a rule, so the list of rules
    bounds it.
    """
    rows = [
        (kind, c, a, gram, len(grams), len(clauses))
        for kind, clauses in queries.items()
        for c, alternatives in enumerate(clauses)
        for a, grams in enumerate(alternatives)
        for gram in sorted(grams)
    ]
    asked = index.sparkSession.createDataFrame(rows, "kind string, clause int, alt int, gram string, n int, clauses int")
    return (
        index.join(F.broadcast(asked), "gram")
        .groupBy("_h", "kind", "clauses", "clause", "alt", "n")
        .agg(F.count("*").alias("c"))
        .where("c = n")
        .groupBy("_h", "kind", "clauses")
        .agg(F.count_distinct("clause").alias("c"))
        .where("c = clauses")
        .groupBy("_h")
        .agg(F.collect_set("kind").alias("_kinds"))
    )


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Leftmost non-overlapping matches as array of (start, kind number, end) in code points.

    Matches and the pieces between them come from the same expression, so the
    running length of both gives the places.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def placed(found: Column) -> Column:
        wanted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        arrays = F.struct(F.split(text, rule.pattern).alias("pieces"), wanted.alias("wanted"))
        zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

        def step(a: Column, m: Column) -> Column:
            start = a["at"] + m["gap"]
            end = start + m["len"]
            span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
            spans = F.when(m["ok"], F.concat(a["spans"], span)).otherwise(a["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        def lengths(b: Column) -> Column:
            one = lambda m, i: F.struct(
                F.length(F.get(b["pieces"], i)).alias("gap"),
                F.length(m).alias("len"),
                (F.length(F.get(b["wanted"], i)) >= rule.least).alias("ok"),
            )
            return F.aggregate(F.transform(found, one), zero, step, lambda a: a["spans"])

        return let(arrays, lengths)

    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(empty))


def scan(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """The input with ``secret_spans``: sorted array of (start, kind, end), kinds numbered as in ``rules``.

    Rules with mandatory trigrams are verified only on the texts that the
    index names for them; the others scan every text.  Null text counts as
    empty.  Rows, also repeated ones, and other columns pass through; a column
    of the name ``secret_spans`` is replaced.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    docs = docs.drop("secret_spans")
    text = text_or_empty(text_col)
    row = docs.select(F.struct("*").alias("_row"), text.alias("_t"), F.xxhash64(text).alias("_h"))
    named = F.array().cast("array<string>")
    if queries:
        grams = sorted({g for q in queries.values() for clause in q for alt in clause for g in alt})
        # Written, so that the join sees its true size and may split a text that very many rows share.
        row = row.join(pinned(candidates(postings(docs, text, grams), queries)), "_h", "left")
        named = F.coalesce(F.col("_kinds"), named)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        spans = matches(F.col("_t"), rule, i)
        parts.append(F.when(F.array_contains(named, rule.kind), spans).otherwise(none) if rule.kind in queries else spans)
    return row.select("_row.*", F.sort_array(F.concat(*parts)).alias("secret_spans"))


def joined(spans: Column, rules: Sequence[Rule] = BASE + MORE) -> Column:
    """``kind:start:end``, comma-joined in the order of the spans."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id", rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """Counts and the digest of the base kinds, and all spans as a string."""
    of = lambda n: F.size(F.filter("secret_spans", lambda s: s["kind"] == n)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] < len(BASE))
    return scanned.select(
        F.col(id_col).alias("doc_id"),
        *[of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(joined(base, rules), 256).alias("base_sha256"),
        joined(F.col("secret_spans"), rules).alias("spans"),
    )


def redact(scanned: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """The texts with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Drops ``secret_spans``.  A null text stays null.
    """
    names = F.array(*[F.lit(r.kind) for r in rules])
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(text, a["at"] + 1, s["start"] - a["at"])
        mark = F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(gap, mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(
        "secret_spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.length(text)))
    )
    clean = F.when(F.size("secret_spans") > 0, whole).otherwise(text)
    return scanned.withColumn(text_col, clean).drop("secret_spans")
