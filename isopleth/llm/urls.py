"""URL filters: stated host/path rules first, then association rules mined from labelled URLs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.llm.text import lower_ascii
from isopleth.session import pinned

#: Kinds of tokens, the most telling first.
KINDS = ("host", "domain", "path", "key", "ext", "scheme", "depth")


@dataclass(frozen=True)
class HostRule:
    """Holds for a host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


STATED = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """Struct (rule, verdict) of the longest stated rule that fits, else null.  For lists of up to some hundreds."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, domain, path segments, extension, query keys; numbers as #."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    plain = lambda x: F.regexp_replace(F.lower(x), r"[0-9]+", "#")
    marked = lambda name, items: F.transform(items, lambda x: F.concat(F.lit(name + "="), plain(x)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))
    depth = F.concat(F.lit("depth="), F.size(F.split(path, "/")).cast("string"))
    every = F.concat(
        marked("scheme", F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        marked("host", labels),
        marked("domain", F.array(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))),
        marked("path", F.split(path, "/")),
        marked("ext", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))),
        marked("key", keys),
        F.array(depth),
    )
    return F.array_distinct(F.filter(every, lambda x: ~F.endswith(x, F.lit("="))))


def _held(urls: DataFrame, known: DataFrame) -> DataFrame:
    """``url`` and ``own``: its tokens that ``known`` (token, item, ...) lists, as their items, sorted."""
    each = urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
    return each.join(known.select("token", "item"), "token").groupBy("url").agg(F.array_sort(F.collect_set("item")).alias("own"))


def _keyed(antecedents: DataFrame, counts: DataFrame) -> DataFrame:
    """``antecedents`` with ``key``, the token that the fewest labelled URLs hold: the index lists them under it."""
    each = antecedents.select("antecedent", F.explode("antecedent").alias("item")).join(counts.select("item", "n").distinct(), "item")
    return each.groupBy("antecedent").agg(F.min(F.struct("n", "item"))["item"].alias("key"))


def _lookup(own: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``own`` with each rule that they fit: found by key in the index, verified on all tokens."""
    found = own.withColumn("key", F.explode("own")).join(rules, "key")
    return found.where(F.size(F.array_except("antecedent", "own")) == 0)


def _baskets(own: str) -> Column:
    """Itemsets of at most 12 tokens that hold every three tokens of ``own`` together."""
    few = f"array({own})"
    blocks = f"transform(sequence(0, cast(ceil(size({own}) / 4) as int) - 1), i -> slice({own}, i * 4 + 1, 4))"
    many = """flatten(transform(sequence(0, size(b) - 3), i -> flatten(transform(sequence(i + 1, size(b) - 2),
        j -> transform(sequence(j + 1, size(b) - 1), k -> concat(b[i], b[j], b[k]))))))"""
    return F.expr(f"CASE WHEN size({own}) <= 12 THEN {few} ELSE transform(array({blocks}), b -> {many})[0] END")


def mine(
    labelled: DataFrame,
    url: Column,
    bad: Column,
    min_bad: int = 5,
    min_confidence: float = 0.8,
    z: float = 3.0,
    partitions: int | None = None,
) -> DataFrame:
    """Rules ``antecedent => block``: rule_id, antecedent, key, n, n_bad, confidence.

    A rule has one to three tokens, at least ``min_bad`` bad labelled URLs, a
    share of bad ones among the labelled URLs that it fits of ``min_confidence``
    or more, and the lower bound of that share (Wilson, ``z`` deviations) above
    the share among all.  The limits are counts and shares of the rows that a
    rule fits, so a rule needs the same evidence in a table of any size.

    FP-growth runs over the bad URLs and proposes token sets; these are then
    counted over all labelled URLs by their rarest token.  Tokens that occur in
    the very same labelled URLs are one item, named after its most telling
    token.  A URL with more than twelve items enters as several baskets that
    hold all its triples, so its cost grows with the third power of its items
    and not with two to their number.  Rules that another rule implies go.
    The driver holds the items with ``min_bad`` bad URLs, as FP-growth does.
    Repeated labels count each; rows without URL or label, and tables without
    bad URLs, give no rules.
    """
    rows = labelled.where(url.isNotNull() & bad.isNotNull()).groupBy(url.alias("url"))
    rows = pinned(rows.agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("n_bad")))
    total = rows.agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")).first()
    telling = F.array_position(F.array(*map(F.lit, KINDS)), F.substring_index("token", "=", 1))
    same = ["n", "n_bad", "mark", "mark2"]
    counts = (
        rows.select("n", "n_bad", F.xxhash64("url").alias("h"), F.xxhash64("url", F.lit(1)).alias("h2"), F.explode(tokens(F.col("url"))).alias("token"))
        .groupBy("token")
        .agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), F.bit_xor("h").alias("mark"), F.bit_xor("h2").alias("mark2"))
        .where(F.col("n_bad") >= min_bad)
    )
    items = counts.groupBy(*same).agg(F.min(F.struct(telling.alias("kind"), "token"))["token"].alias("item"))
    counts = pinned(counts.join(items, same).select("token", "item", "n"))
    own = _held(rows, counts).join(rows, "url")
    own = pinned(own.groupBy("own").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")))

    # A set needs min_bad bad URLs, so more copies of one basket say nothing more.
    copies = F.explode(F.sequence(F.lit(1), F.least("n_bad", F.lit(min_bad)).cast("int")))
    baskets = own.where("n_bad > 0").select(F.explode(_baskets("own")).alias("items"), "n_bad").select("items", copies.alias("copy"))
    baskets = pinned(baskets.select("items"))
    # Half a row below the limit, so that rounding the share up gives the limit itself.
    share = (min_bad - 0.5) / max(baskets.count(), min_bad)
    growth = FPGrowth(itemsCol="items", minSupport=share, minConfidence=1.0)
    if partitions:
        growth = growth.setNumPartitions(partitions)
    proposed = growth.fit(baskets).freqItemsets.where(F.size("items") <= 3).select(F.sort_array("items").alias("antecedent"))
    fits = _lookup(own, _keyed(pinned(proposed), counts))
    counted = fits.groupBy("antecedent", "key").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))

    p, n = F.col("n_bad") / F.col("n"), F.col("n")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    base = (total.n_bad or 0) / (total.n or 1)
    rules = pinned(counted.where((F.col("n_bad") >= min_bad) & (p >= min_confidence) & (low > base)).withColumn("confidence", p))
    parts = F.expr("""transform(sequence(1, cast(shiftleft(1, size(antecedent)) as int) - 2),
        m -> filter(antecedent, (x, i) -> (shiftright(m, i) & 1) = 1))""")
    implied = rules.where(F.size("antecedent") > 1).select("antecedent", F.explode(parts).alias("part"))
    implied = implied.join(rules.select(F.col("antecedent").alias("part")), "part").select("antecedent")
    kept = rules.join(implied, "antecedent", "left_anti").withColumn("rule_id", F.array_join("antecedent", " "))
    return pinned(kept.select("rule_id", "antecedent", "key", "n", "n_bad", "confidence"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` with its best mined rule; only tokens that some rule holds are carried along."""
    used = rules.select(F.explode("antecedent").alias("token")).distinct().withColumn("item", F.col("token"))
    best = F.max(F.struct("confidence", "n_bad", "rule_id")).alias("_best")
    return _lookup(_held(urls, used), rules.select("antecedent", "key", "confidence", "n_bad", "rule_id")).groupBy("url").agg(best)


def judge(
    pages: DataFrame,
    labels: DataFrame,
    stated: Sequence[HostRule] = STATED,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    bad: Column | None = None,
    **mining: float,
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined of every row.

    The longest stated rule decides; where none fits, a mined rule blocks and
    everything else is allowed.  Null URLs and URLs without ``://`` have empty
    host and path and no tokens that rules could hold.  A verdict depends on
    the URL alone, so mined rules are matched once per distinct URL; repeated
    rows and null ids are kept, other columns are not read.  A URL of any
    length is matched on all its tokens.  Of several rules that fit, ``mined``
    is that of the highest confidence, then of the most bad URLs, then by name.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1) if bad is None else bad
    known = rows.join(labels.select(F.col(label_id).alias("page_id"), bad.alias("_bad")), "page_id")
    rules = mine(known, F.col("url"), F.col("_bad"), **mining)
    best = matched(rows.select("url").where(F.col("url").isNotNull()).distinct(), rules)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = rows.join(best, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "_best")
    fixed = stated_rule(F.col("host"), F.col("path"), stated)
    return out.withColumn("_fixed", fixed).select(
        "page_id",
        "host",
        "path",
        F.col("_fixed.rule").alias("rule"),
        F.coalesce("_fixed.verdict", F.when(F.col("_best").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("_fixed").isNull(), F.col("_best.rule_id")).alias("mined"),
    )
