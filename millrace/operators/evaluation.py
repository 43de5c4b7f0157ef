"""The evaluation harness: queries with judgements, or with grades from their own ranking, to metrics."""

from __future__ import annotations

import logging
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .boolean import batch_ranked_boolean, parse
from .index import TextIndex
from .metrics import average_metrics, complete, query_metrics
from .ranking import batch_search

log = logging.getLogger(__name__)
MAX_GRADE = 2

# fixed values: the words that synthetic queries are made of
COMMON_WORDS = """love heart soul death life dream night day time world beauty nature god man woman child
hope fear joy pain tears light dark wind sea sky earth sun moon star flower tree""".split()


def k_values(top_k: int) -> list[int]:
    """The k grid for a result size: 1, 3, 5, 10 up to 10; else 1, tenths of the size, and the size."""
    if top_k <= 10:
        return [k for k in (1, 3, 5, 10) if k <= top_k]
    return sorted({1, top_k, *range(top_k // 10, top_k, top_k // 10)})


def synthetic_queries(n: int, words: list[str] | None = None, seed: int = 0) -> dict[int, str]:
    """Query texts of one to three words, drawn without repeats, by query_id from 1."""
    rng = random.Random(seed)
    return {i + 1: " ".join(rng.sample(words or COMMON_WORDS, rng.randint(1, 3))) for i in range(n)}


def pseudo_grades(ranked: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade): 2 from 0.8 of the query's best score on, 1 from 0.5 on, else 0."""
    share = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    return ranked.select("query_id", "doc_id", F.when(share >= 0.8, 2).when(share >= 0.5, 1).otherwise(0).alias("grade"))


def graded(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, rank, grade) of ranked documents; those without a judgement have grade 0."""
    judged = qrels.select("query_id", "doc_id", "grade")
    return ranked.join(judged, ["query_id", "doc_id"], "left").select("query_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))


def graded_by_document(ranked: DataFrame, grades: DataFrame) -> DataFrame:
    """``graded`` where a document has one grade (doc_id, grade) for all queries."""
    return ranked.join(grades, "doc_id", "left").select("query_id", F.col("rank"), F.coalesce("grade", F.lit(0)).alias("grade"))


def planned(queries: dict[int, str]) -> dict[int, str]:
    """The queries that can be asked; others are logged and left out."""
    out = {}
    for q, text in queries.items():
        try:
            parse(text)
            out[q] = text
        except Exception as e:
            log.warning("query %s is left out: %s", q, e)
    return out


def evaluate(index: TextIndex, queries: dict[int, str], qrels: DataFrame | None = None, top_k: int = 10, mode: str = "tfidf", progress=None) -> tuple[DataFrame, DataFrame, int]:
    """(metrics of every query, their averages, number of queries).

    ``qrels``: (query_id, doc_id, grade); without it a ranking is graded by its own scores, and queries that find
    nothing are left out, as is a query that can't be asked; the number counts all. ``mode``: 'tfidf' or 'boolean'; both
    run all queries in one job. ``progress(share, text)`` is told of the queries (0 to 0.3) and of the work on them.
    """
    tell = progress or (lambda share, text: log.info("%3.0f %% %s", 100 * share, text))
    spark, ks = index.postings.sparkSession, k_values(top_k)
    tell(0.0, f"{len(queries)} queries")
    asked = planned(queries)
    terms = index.batch_terms(asked)
    tell(0.3, "ranking")
    ranked = batch_search(index, terms, top_k)
    if qrels is None:
        qrels = pseudo_grades(ranked)
        counted = qrels.select("query_id").distinct()
    else:
        counted = spark.createDataFrame([(q,) for q in asked], "query_id long")
    if mode == "boolean":
        ranked = batch_ranked_boolean(index, asked, top_k)
    tell(0.6, "metrics")
    metrics = complete(query_metrics(graded(ranked, qrels), ks, MAX_GRADE), counted, ks)
    averages = average_metrics(metrics)
    tell(1.0, "done")
    return metrics, averages, len(queries)
