"""Bounded labelled samples for the classifiers, score calibration and batch scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no classifier may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label int, weight double) of at most ``per_class`` rows of each class that aren't held out.

    Rows are chosen by a hash of their id. ``weight`` is how many labelled rows a row stands for. Repeated labels of an
    id count once, by majority (ties: 1); null labels and ids, and ids without a row in ``docs``, are ignored.
    """
    votes = labels.where(f"{label} IS NOT NULL AND {id_col} IS NOT NULL").groupBy(F.col(id_col).alias("__id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    votes = votes.where(~held_out("__id")).join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi")
    sizes = {r["label"]: r["count"] for r in votes.groupBy("label").count().collect()}  # two rows
    parts = []
    for c in (0, 1):
        n = sizes.get(c, 0)
        weight = n / min(n, per_class) if n else 1.0
        parts.append(votes.where(F.col("label") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class).withColumn("weight", F.lit(weight)))
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(chosen, "__id").withColumnRenamed("__id", "doc_id")


class Isotonic:
    """Calibration by pooling adjacent violators: a monotone map from raw votes to weighted rates of label 1."""

    def __init__(self, raw: np.ndarray, label: np.ndarray, weight: np.ndarray):
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # [sum of raw * weight, positives, weight]
        for x, y, w in zip(raw[order].tolist(), label[order].tolist(), weight[order].tolist(), strict=True):
            pools.append([x * w, y * w, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                a = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
        self.x = np.array([p[0] / p[2] for p in pools])
        self.y = np.array([(p[1] + 0.01) / (p[2] + 0.02) for p in pools])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y) if len(self.x) else np.full(len(raw), 0.5)


def scored(docs: DataFrame, score: Callable[[list], list[pa.Array]], columns: list[tuple[str, str]], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds the ``columns`` (name, Spark type) that ``score`` computes of a list of texts to the carried columns (all by
    default). Only the texts go through Arrow batches. A column of docs with one of the new names is replaced.
    """
    new = [c for c, _ in columns]
    keep = [c for c in (docs.columns if carry is None else carry) if c not in new]
    small_batches(docs.sparkSession)
    names = [c for c, _ in columns]

    def run(texts: pa.Array) -> pa.Array:
        found = score(texts.to_pylist())
        return pa.StructArray.from_arrays(found, names)

    # as if it weren't deterministic: else a filter on the scores would compute them twice
    judge = F.arrow_udf(run, ", ".join(f"{c} {t}" for c, t in columns)).asNondeterministic()
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), judge(F.col(text_col).cast("string")).alias("__judged"))
    return rows.select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"__judged.{c}").alias(c) for c in names))
