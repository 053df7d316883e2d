"""One query for each operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import (
    html_text, language, leaks, licences, neighbours, packing, passages, phrases, quality, simhash, tokens, urls, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_rows(pieces: DataFrame) -> DataFrame:
    """Digest columns of packed pieces; the ids themselves stay out of every shuffle."""
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the rows that are not held out; predicted for all."""
    docs = _table(spark, sf_dir, "documents")
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held_out = F.crc32(number.cast("binary")) % 5 == 0
    model = language.train(docs.filter(~held_out).select("text", "lang"))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed_rows(packing.token_pieces(docs))


@query
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: those of the document whose number is the last segment of a url's path."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    numbered = urls.parse(pages.filter("url is not null")).withColumn(
        "doc_id", F.regexp_extract("__url.path", r"/([0-9]{1,18})(?:\.[^/]*)?/?$", 1).try_cast("long")
    )
    known = numbered.join(labels, "doc_id", "left").select(
        "url", F.when(F.col("bad"), F.lit(urls.BLOCK)).when(~F.col("bad"), F.lit(urls.ALLOW)).alias("label")
    )
    return urls.judge(pages, known).select("page_id", "host", "path", "rule", "verdict", "mined_confidence")


@query
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs).select("doc_id", "licence.*").withColumn("score", F.round("score", 6))


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return simhash.near_duplicates(docs).withColumn("fingerprint", digits)


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality.quality(docs).select("doc_id", *(f"quality.{c}" for c in names))


@query
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.repeated_passages(docs)


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    trees = html_text.train(pages.select("html"))
    return html_text.extract(pages, trees).select("page_id", "url", "text", "n_chars")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.common")


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


@query
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 20."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = neighbours.nearest(rows, rows.filter("vec_id % 20 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "whitening.*")
    parts = F.arrays_zip("whitened", "explained")
    return rows.select("*", F.posexplode(parts).alias("at", "part")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "part.whitened", "part.explained", "identity_error",
    )
