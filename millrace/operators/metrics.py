"""Retrieval quality of ranked lists: P@k, DCG, NDCG, ERR, in long form (query_id, metric, k, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("P", "DCG", "NDCG", "ERR")
DEFAULT_K = (1, 3, 5, 10)


def query_metrics(ranked: DataFrame, ks: list[int] | tuple[int, ...] = DEFAULT_K, max_grade: int = 4) -> DataFrame:
    """The four metrics at every k of ranked lists (query_id, rank from 1, grade).

    P divides by the lesser of k and the list's length. DCG is sum of grade / log2(rank + 1). The ideal order of NDCG is
    that of the retrieved grades. ERR stops at a rank with chance (2^grade - 1) / 2^max_grade; it is 0 if max_grade is.
    A k of 0 or less gives 0. One shuffle by query: every k is a conditional sum of the same rows.
    """
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    by_grade = Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")
    stop = (F.pow(F.lit(2.0), F.col("grade")) - 1) / float(2**max_grade)
    before = by_rank.rowsBetween(Window.unboundedPreceding, -1)
    rows = ranked.withColumn("ideal_rank", F.row_number().over(by_grade)).withColumn("stop", stop)
    rows = rows.withColumn("stays", F.coalesce(F.product(1 - F.col("stop")).over(before), F.lit(1.0)))
    gain = lambda rank: F.col("grade") / F.log2(F.col(rank) + 1)
    sums = []
    for k in ks:
        top, ideal = F.col("rank") <= k, F.col("ideal_rank") <= k
        sums += [
            F.avg(F.when(top, (F.col("grade") > 0).cast("double"))).alias(f"P_{k}"),
            F.sum(F.when(top, gain("rank"))).alias(f"DCG_{k}"),
            F.sum(F.when(ideal, gain("ideal_rank"))).alias(f"IDCG_{k}"),
            F.sum(F.when(top, F.col("stays") * F.col("stop") / F.col("rank"))).alias(f"ERR_{k}"),
        ]
    wide = rows.groupBy("query_id").agg(*sums)
    cells = []
    for k in ks:
        ndcg = F.when(F.col(f"IDCG_{k}") > 0, F.col(f"DCG_{k}") / F.col(f"IDCG_{k}"))
        err = F.col(f"ERR_{k}") if max_grade > 0 else F.lit(0.0)
        for m, v in zip(METRICS, (F.col(f"P_{k}"), F.col(f"DCG_{k}"), ndcg, err), strict=True):
            cells.append(F.struct(F.lit(m).alias("metric"), F.lit(k).cast("long").alias("k"), F.coalesce(v, F.lit(0.0)).cast("double").alias("value")))
    return wide.select("query_id", F.explode(F.array(*cells)).alias("c")).select("query_id", "c.*")


def complete(metrics: DataFrame, queries: DataFrame, ks: list[int] | tuple[int, ...] = DEFAULT_K) -> DataFrame:
    """The metrics of all queries: those with an empty list have 0 everywhere."""
    spark = queries.sparkSession
    grid = spark.createDataFrame([(m, k) for m in METRICS for k in ks], "metric string, k long")
    full = queries.select("query_id").distinct().join(F.broadcast(grid))  # the grid is the caller's
    return full.join(metrics, ["query_id", "metric", "k"], "left").select("query_id", "metric", "k", F.coalesce("value", F.lit(0.0)).alias("value"))


def average_metrics(metrics: DataFrame) -> DataFrame:
    """(metric, k, value): means over queries."""
    return metrics.groupBy("metric", "k").agg(F.avg("value").alias("value"))


def spread(metrics: DataFrame) -> DataFrame:
    """(metric, k, mean, min, max, stdev): sample deviation, 0 for one query."""
    return metrics.groupBy("metric", "k").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"))


def metrics_cells(averages: DataFrame) -> DataFrame:
    """(metric, cells): the values of a metric with four decimals, by rising k, between tabs."""
    cells = F.array_sort(F.collect_list(F.struct("k", F.format_string("%.4f", "value").alias("text"))))
    return averages.groupBy("metric").agg(F.array_join(F.transform(cells, lambda c: c["text"]), "\t").alias("cells"))


def metrics_table(averages: DataFrame) -> str:
    """A tab-separated table with four decimals."""
    rows = averages.collect()  # metrics times k
    if not rows:
        return "No metrics available"
    value = {(r["metric"], r["k"]): r["value"] for r in rows}
    ks = sorted({k for _, k in value})
    head = "Metric\t" + "\t".join(f"@{k}" for k in ks)
    lines = [m + "\t" + "\t".join(f"{value[m, k]:.4f}" for k in ks) for m in METRICS if (m, ks[0]) in value]
    return "\n".join([head, "-" * len(head), *lines])
