"""Sources and sinks: JSON lines with alias fields, the document store, judged queries, result formats."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

log = logging.getLogger(__name__)

# fixed values: the fields of a raw record, in order of preference
ALIASES = {"external_id": ("id", "_id"), "text": ("poem", "text", "content"), "title": ("title", "name"), "author": ("author", "poet"), "year": ("year", "date")}
RAW = T.StructType([T.StructField(a, T.StringType()) for names in ALIASES.values() for a in names])


def read_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Raw records of JSON lines; blank and malformed lines are dropped. ``limit`` counts lines, blank and bad ones too."""
    lines = spark.read.text(path)
    if limit is not None:
        # the first lines of the first files by name: a limit alone takes them from any file
        at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        lines = lines.select("value", *at, F.monotonically_increasing_id().alias("n")).orderBy("file_path", "file_block_start", "n").limit(limit).select("value")
    return parse_lines(lines)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Raw records of a table of lines (value)."""
    # a bad line gives a null record, a good one at least an object
    parsed = lines.where("trim(value) <> ''").select(F.from_json("value", T.StructType([*RAW, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._bad IS NULL").select(*(F.col(f"r.{f.name}").alias(f.name) for f in RAW))


def extract_documents(raw: DataFrame) -> DataFrame:
    """(external_id, text, title, author, year): the first alias that isn't null; without an id a hash of the first
    100 characters stands in. Missing fields are empty."""
    pick = {out: F.coalesce(*(F.col(a) for a in names), F.lit(None)) for out, names in ALIASES.items()}
    text = F.coalesce(pick["text"], F.lit(""))
    made = F.xxhash64(F.substring(text, 1, 100)).cast("string")
    return raw.select(F.coalesce(pick["external_id"], made).alias("external_id"), text.alias("text"), *(F.coalesce(pick[c], F.lit("")).alias(c) for c in ("title", "author", "year")))


def store(documents: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Writes the document store and reads it back."""
    documents.write.mode(mode).parquet(path)
    return documents.sparkSession.read.parquet(path)


def upsert(documents: DataFrame, path: str, key: str = "external_id", progress=None) -> DataFrame:
    """Adds documents to a store; those whose key is there already take the place of the old ones. Of equal keys in
    ``documents`` the last by text stays. ``progress(share, text)``."""
    tell = progress or (lambda share, text: log.info("%3.0f %% %s", 100 * share, text))
    spark = documents.sparkSession
    new = documents.groupBy(key).agg(F.max_by(F.struct(*documents.columns), "text").alias("d")).select("d.*")
    tell(0.1, "merging")
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        old = new.where("false")
    merged = old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    # a store can't be read and overwritten in one job
    aside = f"{path.rstrip('/')}.new"
    merged.write.mode("overwrite").parquet(aside)
    tell(0.7, "writing")
    out = store(spark.read.parquet(aside), path)
    tell(1.0, "done")
    return out


def load_jsonl(spark: SparkSession, path: str, store_path: str, limit: int | None = None) -> DataFrame:
    """JSON lines to an overwritten store."""
    return store(extract_documents(read_jsonl(spark, path, limit)), store_path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder; where a session has none, as on one machine, as it is."""
    spark = df.sparkSession
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        return df
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def number_documents(documents: DataFrame, order: str = "external_id", limit: int | None = None) -> DataFrame:
    """Adds doc_id: 0, 1, ... over the documents with text, in the given order.

    Rows are cut into ranges of the order, numbered inside, and shifted by the counts of the ranges before: no task
    sees all rows.
    """
    rows = documents.where(F.length("text") > 0)
    if limit is not None:
        rows = rows.orderBy(order).limit(limit)
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(F.col(order), tie).sortWithinPartitions(F.col(order), tie).withColumn("__p", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id())
    # written, as both uses must see one partitioning
    ranged = checkpointed(ranged)
    starts = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__n").alias("first"))
    starts = starts.withColumn("before", F.sum("n").over(Window.orderBy("__p")) - F.col("n")).select("__p", "before", "first")
    # as many rows as there are partitions
    return ranged.join(F.broadcast(starts), "__p").withColumn("doc_id", F.col("before") + F.col("__n") - F.col("first")).drop("__p", "__n", "before", "first")


def find_document(documents: DataFrame, doc_id: int) -> DataFrame:
    return documents.where(F.col("doc_id") == doc_id)


def find_documents(documents: DataFrame, ids: list[int], columns: list[str] | None = None) -> DataFrame:
    """The documents of some ids; the filter reaches the scan."""
    return documents.where(F.col("doc_id").isin(ids)).select(*(columns or documents.columns))


def load_test_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries(query_id, query, description), qrels(query_id, doc_id, grade)) of a JSON array of judged queries.

    A missing or unreadable file is logged and gives empty tables.
    """
    schema = "query string, description string, relevance map<string,int>"
    try:
        raw = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("query IS NOT NULL")
    except AnalysisException as e:
        log.error("can't read %s: %s", path, e)
        raw = spark.createDataFrame([], schema)
    numbered = raw.withColumn("query_id", F.row_number().over(Window.orderBy("query", "description")).cast("long"))
    qrels = numbered.select("query_id", F.explode("relevance").alias("doc", "grade")).select("query_id", F.expr("try_cast(doc AS bigint)").alias("doc_id"), "grade")
    return numbered.select("query_id", "query", F.coalesce("description", F.lit("")).alias("description")), qrels.where("doc_id IS NOT NULL")


def as_text(hits: DataFrame) -> DataFrame:
    """A ``line`` per hit: [doc_id] (score: 0.0000) title, then 200 characters of text."""
    return hits.withColumn("line", F.format_string("[%d] (score: %.4f) %s\n%s...\n", "doc_id", F.col("score").cast("double"), "title", F.substring("text", 1, 200)))


def as_json(hits: DataFrame) -> DataFrame:
    """A ``line`` of JSON per hit: doc_id, score, title, text cut at 200 characters."""
    return hits.withColumn("line", F.to_json(F.struct("doc_id", "score", "title", F.substring("text", 1, 200).alias("text"))))
