"""What several operators share: scratch tables, row numbering without a global sort, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Rows of one Arrow batch. Whole texts travel in these batches, so a batch must stay small when texts are long.
ARROW_ROWS = 1000
#: So many edges of a graph fit one task with ease (some 100 MB).
FEW_EDGES = 500_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a new temporary one in local mode, as in tests; on a cluster,
    whose executors would each write to a disk of their own, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_SCRATCH = "spark.millrace.scratch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that ``saved`` writes inside go to a folder of their own, which is deleted at the end: write what is to
    stay before. Outside of this tables stay until the shared folder is cleaned."""
    before = spark.conf.get(_SCRATCH, None)
    path = f"{scratch_dir(spark)}/millrace/scratch-{uuid.uuid4().hex}"
    spark.conf.set(_SCRATCH, path)
    try:
        yield path
    finally:
        spark.conf.unset(_SCRATCH) if before is None else spark.conf.set(_SCRATCH, before)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, tag: str, partition_by: str | None = None, aside: bool = True) -> DataFrame:
    """Writes ``df`` to a new Parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and no block lives on one machine.
    ``aside=False``: the table outlives the ``scratch`` around it.
    """
    spark = df.sparkSession
    # Spark then deletes the shuffle files of this write at its end
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    path = f"{(aside and spark.conf.get(_SCRATCH, None)) or scratch_dir(spark) + '/millrace'}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if partition_by:
        schema = T.StructType([f for f in df.schema if f.name != partition_by] + [df.schema[partition_by]])
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lowers the Arrow batch size of the session to ``rows``; never raises it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(n: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def inline(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of numbers, written into the plan; null in every column if there are no rows."""
    cell = lambda x: "NULL" if x is None else f"{x!r}D" if isinstance(x, float) else f"{x!r}L"
    rows = rows or [(None,) * len(columns.split(", "))]
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)} AS t({columns})"))


def numbered(df: DataFrame, group: str, order: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps inside each ``group``.

    A group may hold any share of the rows: it is cut into ``buckets`` (default: twice the shuffle partitions, 64 at
    least) by a hash of ``order``, rows are numbered inside a bucket, and each bucket starts where the counts of the ones
    before it end. The table of starts has one row per group and bucket. Equal ``order`` values are numbered in
    arbitrary order.
    """
    buckets = buckets or max(64, 2 * partitions(df.sparkSession))
    b, part = "__bucket", [group, "__bucket"]
    rows = df.withColumn(b, bucket_of(buckets, *order))
    starts = (
        rows.groupBy(*part).count()
        .withColumn("__start", F.sum("count").over(W.Window.partitionBy(group).orderBy(b)) - F.col("count"))
        .select(F.col(group).alias("__g"), F.col(b).alias("__b"), "__start")
    )
    inner = rows.withColumn("__row", F.row_number().over(W.Window.partitionBy(*part).orderBy(*order)) - 1)
    joined = inner.join(starts, F.expr(f"`{group}` <=> __g AND {b} = __b"))
    return joined.withColumn(out, (F.col("__start") + F.col("__row")).cast("long")).drop(b, "__row", "__start", "__g", "__b")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges (u, v) of one task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low, high = sorted((find(u), find(v)))
            parent[high] = low
    ids = list(parent)
    for a in range(0, len(ids), 100_000):
        part = ids[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["id", "component"])


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, component) for every id on an edge, component = smallest id.

    Up to ``few`` edges, which are counted, one task joins them. Beyond, large-star and small-star steps (Kiveris et
    al., 2014) alternate until nothing changes; every round is written to the shared folder, and only two numbers a
    round reach the driver. Nulls and loops are ignored; an empty input gives an empty table.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = saved(e.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")), "edges")
    if e.count() <= few:
        return saved(e.coalesce(1).mapInArrow(_union_find, "id long, component long"), "components")
    e, before = saved(e.distinct(), "edges"), None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == before:
            break
        before, e = now, saved(_stars(e), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
