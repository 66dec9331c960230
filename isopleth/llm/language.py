"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isopleth.session import pinned, small_batches

_LETTER = re.compile(r"[^\W\d_]")
_UNSEEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_BLOCK = 1 << 20


def markup_language(html: Column) -> Column:
    """Primary language tag that the html element declares, in lower case; null if there is none."""
    tag = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def visible_text(html: str) -> str:
    """Text of a page: no scripts, styles, comments or tags, entities decoded."""
    return unescape(_TAG.sub(" ", _UNSEEN.sub(" ", html)))


def host_parts(host: Column) -> tuple[Column, Column]:
    """Domain (last two labels) and suffix (last label) of a host; null where it has no dot."""
    labels = F.split(F.lower(host), r"\.")
    dotted = F.size(labels) > 1
    return (
        F.when(dotted, F.array_join(F.slice(labels, -2, 2), ".")),
        F.when(dotted, F.element_at(labels, -1)),
    )


def pairs_of(text: str) -> Iterator[np.ndarray]:
    """Codes of neighbouring bytes of the lower-cased text, block by block."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    for at in range(0, max(len(data) - 1, 0), _BLOCK):
        part = data[at : at + _BLOCK + 1].astype(np.int32)
        yield (part[:-1] << 8) | part[1:]


class TextModel:
    """Naive Bayes over byte pairs.  Picklable: languages and one table of log probabilities."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def mean_log(self, text: str) -> tuple[np.ndarray, int]:
        """Mean log probability per pair and language, and the number of pairs."""
        total, n = np.zeros(len(self.languages)), 0
        for codes in pairs_of(text):
            total += self.table[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return total / max(n, 1), n


def sample_quotas(available: dict[str, int], sample_rows: int, least: int) -> dict[str, int]:
    """Texts to take per language: equal shares, what small languages leave going to larger ones; ``least`` at least."""
    quotas, room = {}, sample_rows
    for at, (lang, n) in enumerate(sorted(available.items(), key=lambda x: (x[1], x[0]))):
        quotas[lang] = min(n, max(least, room // (len(available) - at)))
        room = max(0, room - quotas[lang])
    return quotas


def fitting_sample(known: DataFrame, sample_rows: int, min_rows: int, most_languages: int = 256) -> DataFrame:
    """Rows (l, t): for each language of ``min_rows`` rows its first distinct texts in hash order.

    Of more than ``most_languages`` languages those with the most rows are
    learned, by name where equal: every one is a column of the model.

    At most ``sample_rows`` texts in all, or ``min_rows`` per language if that
    is more.  Only the hashes near a language's quota come to the driver:
    about twice the sample.
    """
    known = known.withColumn("h", F.xxhash64("t"))
    texts = pinned(known.groupBy("l", "h").agg(F.count("*").alias("n")))
    per_lang = texts.groupBy("l").agg(F.sum("n").alias("rows"), F.count("*").alias("texts"))
    common = per_lang.where(F.col("rows") >= min_rows).orderBy(F.desc("rows"), "l").limit(most_languages)
    available = {r["l"]: r["texts"] for r in common.collect()}
    spark = known.sparkSession
    if not available:
        return known.select("l", "t").limit(0)
    quotas = sample_quotas(available, sample_rows, min_rows)
    # Hashes are even over the longs: a share with slack holds the quota's first hashes all but surely.
    low, span = -(1 << 63), (1 << 64) - 1
    edge = {x: low + min(span, span * (2 * q + 50) // available[x]) for x, q in quotas.items()}
    edges = spark.createDataFrame(list(edge.items()), "l string, edge long")
    near = texts.join(F.broadcast(edges), "l").where(F.col("h") <= F.col("edge")).select("l", "h")
    hashes: dict[str, list[int]] = {x: [] for x in quotas}
    for r in near.collect():
        hashes[r["l"]].append(r["h"])
    cuts = [(x, sorted(hs)[: quotas[x]][-1]) for x, hs in hashes.items()]
    cut = spark.createDataFrame(cuts, "l string, cut long")
    taken = known.join(F.broadcast(cut), "l").where(F.col("h") <= F.col("cut"))
    return taken.dropDuplicates(["l", "h"]).select("l", "t")


def fit_text_model(
    docs: DataFrame,
    text: Column,
    declared: Column,
    sample_rows: int = 12_000,
    min_rows: int = 5,
    smoothing: float = 0.5,
    most_pairs: int = 2000,
    most_languages: int = 256,
) -> TextModel:
    """Fit on at most ``sample_rows`` distinct texts, the declared language as label.

    The sample is drawn per language in hash order, copies once, so recomputed
    tasks take the same texts and every language with ``min_rows`` rows or more
    is learned, however many rows the others have, up to ``most_languages``
    (:func:`fitting_sample`).  A
    text counts as a whole but weighs no more than ``most_pairs`` pairs, so one
    long text does not make a language.  Sums come back as one row per
    language.  No rows give a model without languages.
    """
    known = docs.select(declared.alias("l"), text.alias("t")).where("l IS NOT NULL AND t IS NOT NULL")
    picked = fitting_sample(known, sample_rows, min_rows, most_languages)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, t in zip(frame["l"], frame["t"]):
                held = sums.setdefault(lang, np.zeros(1 << 16))
                own = sum((np.bincount(codes, minlength=1 << 16) for codes in pairs_of(t)), np.zeros(1 << 16))
                held += own * min(1.0, most_pairs / max(own.sum(), 1))
        for lang, held in sums.items():
            seen = np.flatnonzero(held)
            yield pd.DataFrame({"l": lang, "code": seen, "n": held[seen]})

    counted = picked.mapInPandas(count, "l string, code int, n double")
    per_code = counted.groupBy("l", "code").agg(F.sum("n").alias("n"))
    per_lang = per_code.groupBy("l").agg(F.collect_list(F.struct("code", "n")).alias("c"))
    rows = sorted(per_lang.collect(), key=lambda r: r["l"])
    table = np.full((1 << 16, len(rows)), smoothing)
    for j, row in enumerate(rows):
        for code, k in row["c"]:
            table[code, j] += k
    return TextModel([r["l"] for r in rows], np.log(table / table.sum(axis=0)).astype(np.float32))


def text_evidence(text: Column, page: Column, model: TextModel, most_pairs: int = 120) -> Column:
    """Log likelihood per language, as of at most ``most_pairs`` pairs since pairs of a text are not independent.

    Where ``page`` holds, the text is HTML and its visible part counts.  Null
    for a text without a letter: it says nothing.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pd.Series, pages: pd.Series) -> pd.Series:
        out = []
        for t, is_page in zip(texts, pages):
            t = visible_text(t) if is_page and t is not None else t
            if t is None or not _LETTER.search(t):
                out.append(None)
                continue
            mean, n = model.mean_log(t)
            out.append((mean * min(n, most_pairs)).tolist())
        return pd.Series(out, dtype=object)

    return score(text, page)


def _best(logs: Column) -> Column:
    """Index of the largest value, the first of equal ones."""
    return (F.array_position(logs, F.array_max(logs)) - 1).cast("int")


def _counts_by(seen: DataFrame, keys: Sequence[str], languages: int, out: str) -> DataFrame:
    return seen.groupBy(*keys).agg(
        F.array(*[F.sum(F.when(F.col("_l") == i, F.col("_c")).otherwise(0)) for i in range(languages)]).alias(out)
    )


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _smoothed(counts: Column, parent: Column, strength: float) -> Column:
    """Shares of ``counts`` drawn towards the parent's shares."""
    return F.transform(
        counts, lambda c, i: (c + F.lit(strength) * F.get(parent, i)) / (_total(counts) + F.lit(strength))
    )


def identify(
    docs: DataFrame,
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    page: Column | None = None,
    wanted: Sequence[str] | None = None,
    min_posterior: float = 0.6,
    prior_strength: float = 20.0,
    sample_rows: int = 12_000,
    most_languages: int = 256,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The input, or its columns ``keep``, with ``lang_id``, ``lang_posterior`` and ``lang_kept``.

    Posterior of a language l: P(text | l) P(declared | l) P(suffix | l)
    P(l | host).  The last is smoothed host -> domain -> all; all counts come
    from one grouped aggregation of the languages that the texts alone point
    to, over every row.  Evidence that is missing (null, or a text without
    letters) is left out.  Where ``page`` holds, the text
    is HTML: its visible part is scored, and the text model is not fitted on
    it.  ``lang_kept``: the text has letters, the best
    language reaches ``min_posterior`` and is among ``wanted`` (null: any
    learned).  Without any learnable language nothing can be said: null
    language, posterior 0, not kept.  At most ``most_languages`` languages are
    learned, those with the most rows; a text in another one gets the likeliest
    of the learned ones or stays uncertain.

    Each text is scored once: what passes through is written with its scores,
    so columns that are not needed, such as a text, are better left out by
    ``keep``.

    Rows, also repeated ones, and other columns pass through; columns of those
    three names are replaced.
    """
    own = ["lang_id", "lang_posterior", "lang_kept"]
    docs = docs.drop(*own)
    kept = [c for c in docs.columns if keep is None or c in keep]
    small_batches(docs.sparkSession)
    declared = F.lit(None).cast("string") if declared is None else declared
    host = F.lit(None).cast("string") if host is None else host
    page = F.lit(False) if page is None else F.coalesce(page, F.lit(False))
    model = fit_text_model(docs, F.col(text_col), F.when(~page, declared), sample_rows, most_languages=most_languages)
    n = len(model.languages)
    if not n:
        empty = {"lang_id": F.lit(None).cast("string"), "lang_posterior": F.lit(0.0), "lang_kept": F.lit(False)}
        return docs.select(*kept).withColumns(empty)
    domain, suffix = host_parts(host)
    # Struct fields cannot clash with the caller's columns.
    row = docs.select(
        (F.struct(*kept) if kept else F.struct(F.lit(None).alias("_none"))).alias("_row"),
        text_evidence(F.col(text_col), page, model).alias("_ll"),
        declared.alias("_declared"),
        host.alias("_host"),
        domain.alias("_domain"),
        suffix.alias("_suffix"),
    )
    row = pinned(row)
    seen = pinned(
        row.where("_ll IS NOT NULL")
        .select("_host", "_domain", "_suffix", "_declared", _best(F.col("_ll")).alias("_l"))
        .groupBy("_host", "_domain", "_suffix", "_declared", "_l")
        .agg(F.count("*").alias("_c"))
    )
    totals = dict(seen.groupBy("_l").agg(F.sum("_c")).collect())
    rows = sum(totals.values())
    flat = [(totals.get(i, 0) + 1) / (rows + n) for i in range(n)]
    overall = F.array(*[F.lit(x) for x in flat])

    def likelihood(key: str, out: str) -> DataFrame:
        """log P(key | language), smoothed by one half per value."""
        of_lang = F.array(*[F.lit(float(totals.get(i, 0))) for i in range(n)])
        table = _counts_by(seen.where(F.col(key).isNotNull()), [key], n, "_k")
        return table.select(key, F.transform("_k", lambda c, i: F.log((c + 0.5) / (F.get(of_lang, i) + 1.0))).alias(out))

    domains = _counts_by(seen.where("_domain IS NOT NULL"), ["_domain"], n, "_k").select(
        "_domain", _smoothed(F.col("_k"), overall, prior_strength).alias("_up")
    )
    hosts = (
        _counts_by(seen.where("_host IS NOT NULL"), ["_host", "_domain"], n, "_k")
        .join(domains, "_domain", "left")
        .select("_host", _smoothed(F.col("_k"), F.coalesce("_up", overall), prior_strength).alias("_prior"))
    )
    scored = (
        row.join(hosts, "_host", "left")
        .join(likelihood("_declared", "_said"), "_declared", "left")
        .join(likelihood("_suffix", "_ends"), "_suffix", "left")
    )
    nothing = F.array(*[F.lit(0.0)] * n)
    terms = [F.coalesce(c, nothing) for c in ("_ll", "_said", "_ends")]
    prior = F.transform(F.coalesce("_prior", overall), lambda p: F.log(p))
    logs = F.transform(prior, lambda p, i: p + sum((F.get(t, i) for t in terms), F.lit(0.0)))
    scored = scored.withColumn("_logs", logs)
    best = F.array_max("_logs")
    mass = F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    names = F.array(*[F.lit(x) for x in model.languages])
    out = scored.select(
        "_row.*",
        F.get(names, _best(F.col("_logs"))).alias("lang_id"),
        (1.0 / mass).alias("lang_posterior"),
        F.col("_ll").isNotNull().alias("_letters"),
    )
    good = F.col("_letters") & (F.col("lang_posterior") >= F.lit(min_posterior))
    if wanted is not None:
        good = good & F.col("lang_id").isin(list(wanted))
    return out.select(*kept, "lang_id", "lang_posterior", good.alias("lang_kept"))
