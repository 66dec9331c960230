"""One query per operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth import session
from isopleth.llm import ann, chat, jaccard, language, lexical, mixture, oracles, packing, periodic, quality, secrets, sharding, urls, warc

#: Target shares of the mixture; names not listed weigh 1.  The hot source is a domain of its own.
WEIGHTS = {"domain": {"crawl": 0.3, "curated": 0.7}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, "source": {}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: str = "source"):
    return F.when(F.col(source) == "src0", F.lit("crawl")).otherwise(F.lit("curated"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page; one of ``doc_id`` and ``page_id`` is null.

    A page declares its language in its markup and has its URL's host; a
    document declares ``lang`` and has no address, so its ``source`` stands for
    the host.  The two are not joined: ``page_id`` numbers pages, and page and
    document of one number have different texts.  Only documents are labels.
    """
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    id_type, page_type = docs.schema["doc_id"].dataType, pages.schema["page_id"].dataType
    rows = docs.select(
        "doc_id", F.lit(None).cast(page_type).alias("page_id"), "text", F.lower("lang").alias("declared"),
        F.col("source").alias("host"), F.lit(False).alias("page"),
    ).unionByName(pages.select(
        F.lit(None).cast(id_type).alias("doc_id"), "page_id", F.col("html").alias("text"),
        language.markup_language(F.col("html")).alias("declared"),
        F.nullif(urls.host_of(F.col("url")), F.lit("")).alias("host"), F.lit(True).alias("page"),
    ))
    found = language.identify(
        rows, declared=F.col("declared"), host=F.col("host"), page=F.col("page"), keep=("doc_id", "page_id", "declared")
    )
    return found.select(
        "doc_id",
        "declared",
        F.col("lang_id").alias("lang"),
        F.col("lang_posterior").alias("posterior"),
        F.col("lang_kept").alias("kept"),
        "page_id",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation that says the template's own control strings.
ODD = r"\### Assistant: </turn> ok"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    odd = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(ODD).alias("text"))
    return chat.digest(chat.format_chats(chat.conversations(rows.unionByName(odd))))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry the label of their own number: an assumption, since ``labels`` names documents."""
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the table has, at the target shares, no document more than four times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    taken = mixture.mix(docs, WEIGHTS, domain_of(), budget=None, max_epochs=4, seed=7)
    return taken.select(
        "doc_id",
        F.col("mix_domain").alias("domain"),
        "lang",
        "source",
        F.col("mix_epoch").alias("epoch"),
        F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_used").alias("used"),
    )


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs, width=3, percent=90)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100."""
    rows = ann.vectors(table(spark, sf_dir, "embeddings"))
    return ann.nearest(rows, F.col("id") % 100 == 0, k=10)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write_archives(warc.with_revisits(pages), session.scratch(spark, "warc"))
    return warc.resolved(warc.read_archives(manifest), files=manifest)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a query, every document a candidate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.collapse(periodic.planted(docs)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_language_id,
        op2_quality_rules,
        op3_chat_formatting,
        op4_url_filters,
        op5_secret_scans,
        op6_source_mixing,
        op7_ngram_jaccard,
        op8_nearest_neighbours,
        op9_warc,
        op10_best_fit_packing,
        op11_lexical_search,
        op12_sharding,
        op13_periodic_runs,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """Learned models, approximate search and packing have no SQL; tests compare them with brute force."""
    return {
        "op3_chat_formatting": oracles.chat_formatting(ODD),
        "op5_secret_scans": oracles.secret_scans(),
        "op6_source_mixing": oracles.source_mixing(WEIGHTS, max_epochs=4, seed=7),
        "op7_ngram_jaccard": oracles.ngram_jaccard(3, 90),
        "op9_warc": oracles.warc_records(),
        "op11_lexical_search": oracles.lexical_search(20),
        "op12_sharding": oracles.sharding(24, "1.0 / 32"),
        "op13_periodic_runs": oracles.periodic_runs(),
    }
