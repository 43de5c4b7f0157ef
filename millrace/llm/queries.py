"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats, read_back
from .embedding_dedup import near_duplicate_vectors
from .kd_sharding import kd_shards
from .mixing import mix
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .labelled import held_out
from .quality_nbsvm import fit_quality, score_quality
from .quality_rules import quality_rules
from .sql import ORACLE_SQL
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import ListedRule, filter_urls, mine_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    judged = score_toxicity(docs, model, carry=["doc_id"])
    return judged.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    judged = score_quality(docs, model, carry=["doc_id"])
    return judged.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


LISTED = [ListedRule("allow", "com"), ListedRule("block", "example.com", "/en/"), ListedRule("allow", "www.example.com", "/en/"), ListedRule("block", "net", "/es/"), ListedRule("block", "net", "/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # labels carry one id for all tables: a page is bad if its row there is of low quality or toxic
    bad = (F.min("quality") == 0) | (F.max("toxic") == 1)
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(bad.cast("int").alias("bad"))
    return filter_urls(pages, LISTED, mine_rules(pages.join(labels, "page_id").select("url", "bad")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(turns.unionByName(more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_toxicity, op3_quality_classifier, op4_embedding_dedup, op5_kd_sharding, op6_length_packing, op7_url_filter, op8_source_mixing, op9_quality_rules, op10_chat_format)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
