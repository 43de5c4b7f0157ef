"""TF-IDF ranking: term weights, one query, many queries."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .index import TextIndex


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 1; 0 without documents or for an unknown term."""
    return F.when((n_docs > 0) & (df > 0), F.log((n_docs + 1) / (df + 1)) + 1).otherwise(0.0)


def tf(count: Column, doc_len: Column) -> Column:
    return F.when(doc_len > 0, count / doc_len).otherwise(0.0)


def _query_table(index: TextIndex, queries: dict[int, list[str]]) -> DataFrame:
    """(query_id, term, qtf): repeats of a term in a query count."""
    rows = [(q, t, n) for q, terms in queries.items() for t, n in Counter(terms).items()]
    return index.postings.sparkSession.createDataFrame(rows, "query_id long, term string, qtf long")


def term_weights(index: TextIndex, terms: list[str]) -> DataFrame:
    """(position, term, df, idf) of a list of terms, in order."""
    asked = index.postings.sparkSession.createDataFrame(list(enumerate(terms)), "position long, term string")
    df = index.postings.where(F.col("term").isin(sorted(set(terms)))).groupBy("term").agg(F.count("*").alias("df"))
    out = asked.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).join(F.broadcast(index.document_count()))
    return out.select("position", "term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf")).orderBy("position")


def term_scores(index: TextIndex) -> DataFrame:
    """tf, raw tf, idf and their product for every posting: (term, doc_id, tf, raw_tf, idf, tfidf)."""
    rows = index.postings.join(index.document_frequencies().select("term", "df"), "term").join(index.doc_stats, "doc_id").join(F.broadcast(index.document_count()))
    t, w = tf(F.col("tf"), F.col("doc_len")), idf(F.col("n_docs"), F.col("df"))
    return rows.select("term", "doc_id", t.alias("tf_norm"), F.col("tf").cast("double").alias("raw_tf"), w.alias("idf"), (t * w).alias("tfidf"))


def batch_scores(index: TextIndex, queries: dict[int, list[str]]) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term with a query.

    The queries' terms are broadcast: they come from the caller's memory. Postings are filtered by term at the scan.
    """
    asked = _query_table(index, queries)
    terms = sorted({t for q in queries.values() for t in q})
    hits = index.postings.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weights = asked.join(df, "term").join(F.broadcast(index.document_count()))
    weights = weights.select("query_id", "term", (F.col("qtf") * idf(F.col("n_docs"), F.col("df"))).alias("w"))
    rows = hits.join(F.broadcast(weights), "term").join(index.doc_stats, "doc_id")
    return rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * tf(F.col("tf"), F.col("doc_len"))).alias("score")).where("score > 0")


def score_terms(index: TextIndex, terms: list[str]) -> DataFrame:
    """(doc_id, score) of one query's terms."""
    return batch_scores(index, {0: terms}).select("doc_id", "score")


def search(index: TextIndex, query: str | list[str], k: int = 10) -> DataFrame:
    """The k best documents (doc_id, score); ties by doc_id. A text goes through the pipeline, a list is terms."""
    terms = index.query_terms(query) if isinstance(query, str) else query
    return score_terms(index, terms).orderBy(F.desc("score"), "doc_id").limit(k)


def batch_search(index: TextIndex, queries: dict[int, list[str]], k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of every query, in one job."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = batch_scores(index, queries).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def hydrate(hits: DataFrame, documents: DataFrame, snippet: int = 500) -> DataFrame:
    """Hits joined to their documents; hits without a document are dropped. Adds a snippet of the text."""
    cut = F.concat(F.substring("text", 1, snippet), F.lit("..."))
    # a few hits are broadcast by the planner; those of a large batch are joined by id
    return documents.join(hits, "doc_id").withColumn("snippet", cut)
