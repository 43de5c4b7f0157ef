"""The inverted index as plain tables: documents, postings, doc_stats, terms, corpus.

A saved index is a folder of parts and a log. A save or an append first writes its tables as a part of its own and then
adds one row to the log; readers take the last save and the appends behind it. So a write is there as a whole or not at
all, and an append whose batch is in the log already does nothing. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .pipeline import PipelineOptions, TextPipeline
from .store import StoreOptions, pack_documents, unpack_documents

TABLES = ("documents", "postings", "doc_stats")
LOG = "step long, kind string, batch string, part string"
SAVE, ADD, CLEAR = "save", "add", "clear"
NO_DOCUMENTS, NO_POSTINGS = "doc_id long, text string", "term string, doc_id long, tf long"


@dataclass
class TextIndex:
    """``documents`` (doc_id, text, ...), ``postings`` (term, doc_id, tf), ``doc_stats`` (doc_id, doc_len).

    Documents without terms are in ``documents`` and ``doc_stats``, not in ``postings``.
    """

    documents: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    pipeline: TextPipeline

    @classmethod
    def build(cls, docs: DataFrame, options: PipelineOptions = PipelineOptions(), id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
        """Tokenises the documents once; null texts count as empty."""
        pipeline = TextPipeline(options)
        docs = docs.withColumnRenamed(id_col, "doc_id").withColumnRenamed(text_col, "text")
        postings = pipeline.term_counts(docs).select("term", "doc_id", "tf")
        return cls._with_stats(docs, postings, pipeline)

    @classmethod
    def from_terms(cls, docs: DataFrame, options: PipelineOptions = PipelineOptions()) -> TextIndex:
        """From ready terms: (doc_id, terms array<string>, and text if there is one)."""
        counts = docs.select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
        documents = docs.drop("terms") if "text" in docs.columns else docs.drop("terms").withColumn("text", F.lit(""))
        return cls._with_stats(documents, counts, TextPipeline(options))

    @classmethod
    def _with_stats(cls, docs: DataFrame, postings: DataFrame, pipeline: TextPipeline) -> TextIndex:
        lengths = postings.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))
        stats = docs.select("doc_id").join(lengths, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))
        return cls(docs, postings, stats, pipeline)

    def save(self, path: str, store: StoreOptions = StoreOptions()) -> TextIndex:
        """Writes the tables, postings clustered by term so that a filter on terms prunes row groups; reads them back.
        What was at ``path`` before is no longer read."""
        spark = self.documents.sparkSession
        _commit(spark, path, SAVE, uuid.uuid4().hex, self._write(path, store))
        return self.load(spark, path, self.pipeline.options)

    def _write(self, path: str, store: StoreOptions) -> str:
        part = f"parts/{uuid.uuid4().hex}"
        spark, at = self.documents.sparkSession, f"{path}/{part}"
        self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{at}/postings")
        postings = spark.read.parquet(f"{at}/postings")
        self._with_stats(self.documents, postings, self.pipeline).doc_stats.write.parquet(f"{at}/doc_stats")
        pack_documents(self.documents, store).write.parquet(f"{at}/documents")
        return part

    @classmethod
    def load(cls, spark: SparkSession, path: str, options: PipelineOptions = PipelineOptions()) -> TextIndex:
        """The index at ``path``; empty if there is none or it was cleared."""
        parts = [f"{path}/{r['part']}" for r in _live(spark, path) if r["part"]]
        if not parts:
            return cls._with_stats(spark.createDataFrame([], NO_DOCUMENTS), spark.createDataFrame([], NO_POSTINGS), TextPipeline(options))
        # a part may be stored in another form than its neighbours
        documents = [unpack_documents(spark.read.parquet(f"{p}/documents")) for p in parts]
        whole = documents[0]
        for d in documents[1:]:
            whole = whole.unionByName(d, allowMissingColumns=True)
        return cls(whole, *(spark.read.parquet(*(f"{p}/{t}" for p in parts)) for t in TABLES[1:]), TextPipeline(options))

    @classmethod
    def append(cls, spark: SparkSession, path: str, docs: DataFrame, options: PipelineOptions = PipelineOptions(), *, batch: str | None = None, store: StoreOptions = StoreOptions()) -> TextIndex:
        """Adds documents (doc_id, text, ...) with new ids to a saved index, once: a ``batch`` that was added since the
        last save is left alone. Without a name a batch is known by its ids and texts."""
        if batch is None:
            n, mark = docs.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).first()
            batch = f"{n}:{mark}"
        if not any(r["kind"] == ADD and r["batch"] == batch for r in _live(spark, path)):
            _commit(spark, path, ADD, batch, cls.build(docs, options)._write(path, store))
        return cls.load(spark, path, options)

    @classmethod
    def add(cls, spark: SparkSession, path: str, docs: DataFrame, options: PipelineOptions = PipelineOptions(), *, order: str = "text", batch: str | None = None, store: StoreOptions = StoreOptions()) -> TextIndex:
        """Adds documents (text, and title or others) under the next free ids, in the order of a column. Repeats of a
        ``batch`` do nothing; without a name every call adds."""
        from ..sources.ingest import number_documents

        last = cls.load(spark, path, options).documents.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).first()[0]
        numbered = number_documents(docs, order).withColumn("doc_id", (F.col("doc_id") + F.lit(last + 1)).cast("long"))
        return cls.append(spark, path, numbered, options, batch=batch or uuid.uuid4().hex, store=store)

    @classmethod
    def clear(cls, spark: SparkSession, path: str, options: PipelineOptions = PipelineOptions()) -> TextIndex:
        """Empties a saved index: ids start at 0 again."""
        _commit(spark, path, CLEAR, uuid.uuid4().hex, "")
        return cls.load(spark, path, options)

    # statistics, each a table of its own: nothing is collected

    def document_count(self) -> DataFrame:
        """n_docs, documents without terms included."""
        return self.documents.agg(F.count("*").alias("n_docs"))

    def document_frequencies(self) -> DataFrame:
        """(term, df, cf)"""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def vocabulary_size(self) -> DataFrame:
        return self.postings.agg(F.countDistinct("term").alias("n_terms"))

    def average_length(self) -> DataFrame:
        return self.doc_stats.agg(F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_doc_len"))

    def posting_list(self, term: str) -> DataFrame:
        """(doc_id, tf) of a term, ascending."""
        return self.postings.where(F.col("term") == term).select("doc_id", "tf").orderBy("doc_id")

    def contains(self, term: str) -> bool:
        return not self.postings.where(F.col("term") == term).isEmpty()

    def term_frequencies(self, asked: DataFrame) -> DataFrame:
        """tf of (doc_id, term) rows, 0 if absent."""
        return asked.join(self.postings, ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce("tf", F.lit(0)).alias("tf"))

    def lengths(self, asked: DataFrame) -> DataFrame:
        """doc_len of doc_id rows, 0 if unknown."""
        return asked.join(self.doc_stats, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))

    def texts(self, asked: DataFrame, col: str = "text") -> DataFrame:
        """Text (or another column) of doc_id rows, empty if unknown."""
        return asked.join(self.documents.select("doc_id", col), "doc_id", "left").select("doc_id", F.coalesce(col, F.lit("")).alias(col))

    def normalized(self, words: list[str]) -> list[str]:
        """Query words as terms, in order, repeats kept."""
        if not words:
            return []
        spark = self.postings.sparkSession
        rows = self.pipeline.normalize(spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")).collect()  # the query's words
        terms = {r["word"]: r["term"] for r in rows}
        return [terms[w] for w in words]

    def query_terms(self, query: str) -> list[str]:
        """The terms of a query text, through the whole pipeline."""
        return self.batch_terms({0: query})[0]

    def batch_terms(self, queries: dict[int, str]) -> dict[int, list[str]]:
        """The terms of many query texts, in one job."""
        if not queries:
            return {}
        asked = self.postings.sparkSession.createDataFrame(list(queries.items()), "doc_id long, text string")
        found = {r["doc_id"]: list(r["terms"] or []) for r in self.pipeline.terms(asked).collect()}  # the queries' words
        return {q: found.get(q, []) for q in queries}


def _log(spark: SparkSession, path: str) -> list:
    """The rows of the log, in order: as many as there were writes."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log").orderBy("step", "part").collect()
    except AnalysisException:
        return []


def _live(spark: SparkSession, path: str) -> list:
    """The log from the last save or clearing on."""
    rows = _log(spark, path)
    return rows[max((i for i, r in enumerate(rows) if r["kind"] != ADD), default=0) :]


def _commit(spark: SparkSession, path: str, kind: str, batch: str, part: str) -> None:
    step = max((r["step"] for r in _log(spark, path)), default=-1) + 1
    spark.createDataFrame([(step, kind, batch, part)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
