"""The corpus pipeline: toxicity, quality, near-duplicates, mixing and packing over the documents.

Each stage takes what its predecessor kept, as a table written and read again, and decides on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import saved, scratch
from millrace.llm.mixing import sampled
from millrace.llm.ngram_join import ngram_jaccard_join
from millrace.llm.packing import pack
from millrace.llm.quality_nbsvm import fit_quality, score_quality
from millrace.llm.toxicity import fit_toxicity, score_toxicity

#: SQL can't express learned scores or components of a similarity graph; the stages are tested by brute force.
ORACLE_SQL = None


#: So many ids are broadcast at most: 8 MB.
FEW_IDS = 1_000_000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted to be toxic.

    A null or empty text is judged as ``score_toxicity`` says; repeated rows are judged alike and stay together; without
    labelled rows nothing goes; an empty table gives an empty result. Columns named like those of the scores, and any
    others, are returned as they came.
    """
    model = fit_toxicity(docs, _labels(spark, sf_dir))
    rows = docs.select("text", F.struct(*docs.columns).alias("__row"))
    judged = score_toxicity(rows, model, carry=["__row"]).where("predicted = 0")
    return judged.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted to be of low quality.

    A null text is judged as an empty one; repeated rows are judged alike and stay together; without labelled rows nothing
    goes; an empty table gives an empty result. Columns named like those of the scores, and any others, are returned as
    they came.
    """
    model = fit_quality(docs, _labels(spark, sf_dir))
    rows = docs.select("text", F.struct(*docs.columns).alias("__row"))
    judged = score_quality(rows, model, carry=["__row"]).where("predicted = 1")
    return judged.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group linked by five-word shingles at a similarity of 0.8.

    Rows that repeat an id with an equal text count once; unlike texts of one id are documents each, and of a group with
    several rows of the smallest id one stays. Documents without an id or without words stay; an empty table gives an
    empty result; other columns are returned as they came.
    """
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _repeated_ids(docs)
    found = saved(ngram_jaccard_join(docs, width=5, percent=80).where("doc_id IS NOT NULL"), "groups")
    gone = saved(found.where("component_id <> doc_id").select("doc_id"), "gone")
    # ids of 8 bytes: while they are few, which is counted, they go to the texts, else both are dealt by id
    few = gone.count() <= FEW_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def _repeated_ids(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` where ids repeat: rows get numbers of their own."""
    own = docs.where("doc_id IS NOT NULL").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
    own = saved(own.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = ngram_jaccard_join(own, id_col="__row", width=5, percent=80).select("__row", "component_id")
    kept = found.join(own.select("__row", "doc_id"), "__row").groupBy("component_id").agg(F.min_by("__row", F.struct("doc_id", "__row")).alias("__row"))
    out = own.join(saved(kept.select("__row"), "kept"), "__row", "left_semi").select(*docs.columns)
    return out.unionByName(docs.where("doc_id IS NULL"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards the target shares of source, language and topic.

    Null categories belong to the class of all others; a document without words is kept if its cell has no tokens, else
    decided like its cell; rows that repeat an id are decided alike; an empty table gives an empty result; other columns
    are returned as they came.
    """
    return sampled(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents into padded batches of optimal length buckets.

    Null and empty texts have no tokens and go to the smallest bucket, very long ones are batches of their own; repeated
    rows are packed each; an empty table gives an empty result; other columns are neither read nor returned.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage writes for itself is deleted behind it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            docs = saved(made, name, aside=False)
    return docs
