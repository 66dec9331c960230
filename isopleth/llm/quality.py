"""Quality rules: text statistics and a decision list learned by sequential covering."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.llm.text import let, text_or_empty, words
from isopleth.session import pinned

SYMBOLS = "#*$%&|<>"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(w: Column, width: int = 3) -> Column:
    """How many words lie in windows of ``width`` words found twice or more, the first included.

    Windows are sorted with their positions, so equal ones become neighbours;
    each such window then adds the words that the one before it did not cover.
    """
    position = lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("i"))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - width), position))

    def covered(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(
            x["h"] == F.get(s, k + 1)["h"], F.lit(False)
        )
        places = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    return F.when(F.size(w) > width, let(windows, covered)).otherwise(F.lit(0))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and :data:`STATISTICS` (long) of every whole text, in one pass without a shuffle.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line), n_repeat_words.  Null text has no
    words; a null id and repeated rows are kept; other columns are not read.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), words(text).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    return base.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).cast("long").alias("n_repeat_words"),
    )


def features() -> dict[str, Column]:
    """What conditions may look at: sizes and shares that do not depend on the length of a text."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    """``feature > cut`` or ``feature <= cut``."""

    feature: str
    above: bool
    cut: float

    def holds(self, columns: Mapping[str, Column]) -> Column:
        c = columns[self.feature]
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


@dataclass(frozen=True)
class Rule:
    """A conjunction that tells the sought class, with its precision on rows not used to grow it."""

    conditions: tuple[Condition, ...]
    precision: float
    support: int

    def holds(self, columns: Mapping[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, (c.holds(columns) for c in self.conditions))


def decision_list(rules: list[Rule], columns: Mapping[str, Column], value: bool, otherwise: bool) -> Column:
    """The rules in their order as one CASE expression."""
    out = F.lit(otherwise)
    for rule in reversed(rules):
        out = F.when(rule.holds(columns), F.lit(value)).otherwise(out)
    return out


def learn(
    labelled: DataFrame,
    target: Column,
    columns: Mapping[str, Column],
    id_col: str = "doc_id",
    cuts: int = 32,
    max_conditions: int = 3,
    min_precision: float = 0.95,
    min_support: int = 5,
    max_rules: int = 12,
) -> list[Rule]:
    """Rules for ``target``, each learned on the rows that the ones before it leave.

    Rows are first counted per combination of feature intervals (``cuts``
    quantiles each), separately for growing and pruning (a third of the ids),
    and every later step is one aggregation of that table to at most
    features x features x cuts rows.  A rule is grown from the best condition
    of each feature, by the condition with the largest information gain, until
    it covers no other class.  Of these rules and their shorter beginnings,
    the one that catches most on the pruning rows at ``min_precision`` or
    better is taken, and learning ends when there is none with
    ``min_support``.  Rows without a label do not count; no labels give no
    rules.
    """
    names = list(columns)
    known = labelled.where(target.isNotNull()).select(
        *[c.alias(n) for n, c in columns.items()], target.cast("long").alias("_yes"), F.col(id_col).alias("_id")
    )
    probs = [i / cuts for i in range(1, cuts)]
    edges = known.agg(*[F.percentile_approx(n, probs, 10_000).alias(n) for n in names]).first()
    grid = {n: sorted(set(edges[n] or [])) for n in names}
    bins = [sum((F.when(F.col(n) > F.lit(c), 1).otherwise(0) for c in grid[n]), F.lit(0)).alias(n) for n in names]
    cells = pinned(
        known.select(*bins, "_yes", (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("_prune"))
        .groupBy(*names, "_prune")
        .agg(F.sum("_yes").alias("_p"), F.sum(1 - F.col("_yes")).alias("_n"))
    )
    binned = {n: F.col(n) for n in names}

    def holds(conditions: tuple[Condition, ...]) -> Column:
        return reduce(lambda a, b: a & b, (c.holds(binned) for c in conditions), F.lit(True))

    def extended(rows: DataFrame, starts: list[tuple[Condition, ...]]) -> dict[int, dict[str, tuple]]:
        """For each start and feature: (gain, condition, others left) of the best condition on interval numbers."""
        chosen = F.array_compact(F.array(*[F.when(holds(s), F.lit(i)) for i, s in enumerate(starts)]))
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names]))
        table = (
            rows.select(F.explode(chosen).alias("s"), *names, "_p", "_n")
            .select("s", pairs.alias("x"), "_p", "_n")
            .groupBy("s", "x.f", "x.b")
            .agg(F.sum("_p").alias("p"), F.sum("_n").alias("n"))
        )
        by: dict[tuple[int, str], dict[int, tuple[int, int]]] = {}
        for s, f, b, p, n in sorted(map(tuple, table.collect())):
            by.setdefault((s, f), {})[b] = (int(p), int(n))
        out: dict[int, dict[str, tuple]] = {i: {} for i in range(len(starts))}
        for (s, f), held in by.items():
            all_p, all_n = (sum(v[i] for v in held.values()) for i in (0, 1))
            below_p = below_n = 0
            for b in range(len(grid[f])):
                p, n = held.get(b, (0, 0))
                below_p, below_n = below_p + p, below_n + n
                for above, q, m in ((False, below_p, below_n), (True, all_p - below_p, all_n - below_n)):
                    if q:
                        gain = q * (math.log2(q / (q + m)) - math.log2(all_p / (all_p + all_n)))
                        if gain > max(1e-9, out[s].get(f, (0.0,))[0]):
                            out[s][f] = (gain, Condition(f, above, b), m)
        return out

    rules: list[Rule] = []
    left = cells
    while len(rules) < max_rules:
        grow, hold = left.where("NOT _prune"), left.where("_prune")
        found = extended(grow, [()])[0]
        grown, going = [], []
        for _, c, others in found.values():
            (going if others and max_conditions > 1 else grown).append((c,))
        while going:
            after = extended(grow, going)
            longer = []
            for i, start in enumerate(going):
                if not after[i]:
                    grown.append(start)
                    continue
                _, c, others = max(after[i].values(), key=lambda x: x[0])
                (longer if others and len(start) + 1 < max_conditions else grown).append((*start, c))
            going = longer
        tried = sorted({r[:k] for r in grown for k in range(1, len(r) + 1)}, key=lambda r: (len(r), str(r)))
        if not tried:
            break
        sums = [F.sum(F.when(holds(r), F.col(c)).otherwise(0)) for r in tried for c in ("_p", "_n")]
        got = [int(x or 0) for x in hold.agg(*sums).first()]
        best = None
        for r, p, n in zip(tried, got[::2], got[1::2]):
            if p + n >= min_support and p / (p + n) >= min_precision and (best is None or p > best[1]):
                best = (r, p, n)
        if best is None:
            break
        taken, p, n = best
        by_value = tuple(Condition(c.feature, c.above, float(grid[c.feature][int(c.cut)])) for c in taken)
        rules.append(Rule(by_value, p / (p + n), p + n))
        left = left.where(~holds(taken))
    return rules


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Statistics of every document with ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` percent of them in repeated windows.  ``kept``: not
    base_failed and not caught by the decision list learned from the labels
    (0 is bad; null labels are ignored).
    """
    stats = pinned(statistics(docs, id_col, text_col))
    known = stats.join(labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("_label")), "doc_id")
    rules = learn(known, F.col("_label") == 0, features())
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    verdict = decision_list(rules, features(), value=False, otherwise=True)
    return stats.select("doc_id", *STATISTICS, failed.alias("base_failed"), (~failed & verdict).alias("kept"))
