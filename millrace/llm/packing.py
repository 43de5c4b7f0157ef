"""Packing into optimal length buckets.

One histogram of the lengths of all documents, by aligned length, gives a dynamic programme the bucket boundaries of
least padding. Documents are then numbered inside their bucket and cut into batches of at most a token budget, every
document padded to its bucket's length. The histogram has at most ``budget / align`` rows, whatever the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, saved
from .mixing import word_count


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The at most ``buckets`` boundaries, a subset of the ascending ``lengths`` with the last, of least total padding.

    best[k][j] = min over i of best[k - 1][i] + (documents in i..j) * length j. Ties go to the smallest i.
    """
    if not lengths:
        return []
    size = np.asarray(lengths, np.float64)
    before = np.r_[0, np.cumsum(np.asarray(counts, np.float64))]
    n, k = len(lengths), min(buckets, len(lengths))
    best = np.r_[0.0, np.full(n, np.inf)]
    back = np.zeros((k + 1, n + 1), np.int64)
    for level in range(1, k + 1):
        new = np.full(n + 1, np.inf)
        for j in range(level, n + 1):
            cost = best[:j] + (before[j] - before[:j]) * size[j - 1]
            back[level, j] = i = int(cost.argmin())
            new[j] = cost[i]
        best = new
    out, j = [], n
    for level in range(k, 0, -1):
        out.append(lengths[j - 1])
        j = back[level, j]
    return out[::-1]


def pack(docs: DataFrame, *, budget: int = 32768, buckets: int = 16, align: int = 8, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """Puts every document into a padded batch: doc_id, n_tokens long, bucket int, padded long (tokens with padding),
    batch long (number in the bucket), place long (0, 1, ... in the batch).

    A batch holds at most ``budget`` padded tokens. Length is the number of words unless ``tokens_col`` names a column
    of token counts. Boundaries are multiples of ``align``. A document longer than the budget is a batch of its own in
    bucket -1, padded to its own aligned length: nothing is cut or dropped.

    Defined results: a null or empty text has no tokens and goes to the smallest bucket, as does a null count; repeated
    rows and ids are packed each; an empty table gives an empty result; other columns are ignored.
    """
    if budget % align or budget < align:
        raise ValueError("the budget must be a multiple of align")
    n = F.greatest(F.coalesce(F.col(tokens_col), F.lit(0)), F.lit(0)).cast("long") if tokens_col else word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), n.alias("n_tokens"), F.xxhash64(F.col(id_col)).alias("__o"))
    rows = saved(rows.withColumn("aligned", F.greatest(F.ceil(F.col("n_tokens") / align), F.lit(1)) * align), "lengths")
    hist = rows.where(F.col("aligned") <= budget).groupBy("aligned").count().orderBy("aligned").collect()
    ends = best_boundaries([r["aligned"] for r in hist], [r["count"] for r in hist], buckets)
    bucket, padded = F.lit(-1), F.col("aligned")
    for i, end in reversed(list(enumerate(ends))):
        inside = F.col("aligned") <= end
        bucket, padded = F.when(inside, F.lit(i)).otherwise(bucket), F.when(inside, F.lit(end)).otherwise(padded)
    rows = rows.select("doc_id", "n_tokens", bucket.cast("int").alias("bucket"), padded.cast("long").alias("padded"), "__o")
    rows = numbered(rows, "bucket", ["__o", "doc_id"], "row")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded")))
    return rows.select("doc_id", "n_tokens", "bucket", "padded", F.floor(F.col("row") / room).alias("batch"), (F.col("row") % room).alias("place"))
