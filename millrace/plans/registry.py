"""All registered queries of the retrieval engine. Their SQL is in ``sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lzw, strings
from ..functions.lemma import Lexicon, lemmatize_words
from ..functions.stem import stem_words
from ..functions.tokens import TokenOptions, token_rows, words
from ..operators import boolean, evaluation, metrics, ranking, zipf
from ..operators.index import TextIndex
from ..operators.pipeline import PipelineOptions, TextPipeline
from ..operators.store import StoreOptions, pack_documents, unpack_documents
from ..sources import ingest
from . import constants as c
from .sql import ORACLE_SQL

PLAIN = PipelineOptions(stem=False)
WORDS = TokenOptions(min_length=2, max_length=100)
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def plain_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return TextIndex.build(documents(spark, sf_dir), PLAIN)


def stemmed_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return TextIndex.build(documents(spark, sf_dir), PipelineOptions())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF top-k of one query."""
    return tfidf_topk(spark, sf_dir)


# tokenizer


@query
def tokenize_words(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", words(F.col("text"), WORDS).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words"))


@query
def tokenize_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", words(F.col("html"), WORDS).alias("w"))
    return rows.select("page_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words"))


@query
def token_offsets(spark, sf_dir):
    return token_rows(documents(spark, sf_dir), TokenOptions()).select("doc_id", "token", "position", "length")


@query
def token_types(spark, sf_dir):
    keep = TokenOptions(False, False, False, False)
    found = token_rows(table(spark, sf_dir, "pages"), keep, "page_id", "html")
    return found.groupBy("doc_id", "token_type").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.max("position").alias("last_position"))


@query
def token_counts_by_lang(spark, sf_dir):
    rows = documents(spark, sf_dir).select("lang", F.size(words(F.col("text"), WORDS)).alias("n"))
    return rows.groupBy("lang").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_docs"))


# strings


@query
def str_case(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", strings.to_lower(t).alias("lower"), strings.to_upper(t).alias("upper"))


@query
def str_normalize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", strings.normalize(F.col("text")).alias("normal"))


@query
def str_remove_punct(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", strings.remove_punctuation(F.col("text")).alias("bare"))


@query
def str_trim(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit("\r\n "))
    return documents(spark, sf_dir).select("doc_id", strings.trim(padded).alias("trimmed"))


@query
def str_split_join(spark, sf_dir):
    parts = strings.split(F.col("text"), ".")
    return documents(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("n_parts"), strings.join(parts, ", ").alias("joined"))


@query
def str_find(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", strings.find(t, "the").cast("long").alias("first_the"), strings.find(t, "the", 20).cast("long").alias("later_the"), strings.rfind(t, "a").cast("long").alias("last_a"))


@query
def str_prefix_suffix(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", strings.starts_with(t, "Th").alias("starts"), strings.ends_with(t, ".").alias("ends"), strings.substr(t, 3, 5).alias("part"), strings.size_bytes(t).alias("bytes"), (t < "M").alias("before_m"))


@query
def str_append(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", strings.append(F.col("text"), F.lit(" "), F.col("source"), strings.repeated("!", 3)).alias("longer"))


@query
def str_numbers(spark, sf_dir):
    x = F.col("l_extendedprice").cast("double") / 7
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", strings.number_text(F.col("l_orderkey")).alias("key_text"), strings.double_text(x, 2).alias("price_text"))
    return rows


@query
def hex_roundtrip(spark, sf_dir):
    digits = strings.hex_encode(F.col("text").cast("binary"))
    return documents(spark, sf_dir).select("doc_id", F.length(digits).cast("long").alias("n_digits"), F.decode(strings.hex_decode(digits), "UTF-8").alias("text"))


# stems and lemmas


def vocabulary(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select(F.explode(words(F.col("text"), WORDS)).alias("word")).distinct()


@query
def stem_vocab(spark, sf_dir):
    return stem_words(vocabulary(spark, sf_dir))


@query
def stem_postings(spark, sf_dir):
    return TextPipeline(PipelineOptions()).term_counts(documents(spark, sf_dir))


@query
def stem_tfidf_topk(spark, sf_dir):
    index = stemmed_index(spark, sf_dir)
    return rounded(ranking.search(index, index.query_terms(c.STEM_QUERY), c.TOP_K))


@query
def lemma_user_entries(spark, sf_dir):
    lexicon = Lexicon()
    for word, lemma in c.USER_LEMMAS:
        lexicon.add(word, lemma)
    return lemmatize_words(vocabulary(spark, sf_dir), lexicon)


@query
def lemma_vocab(spark, sf_dir):
    return lemmatize_words(vocabulary(spark, sf_dir), Lexicon())


@query
def pipeline_terms(spark, sf_dir):
    rows = TextPipeline(PLAIN).terms(documents(spark, sf_dir))
    return rows.select("doc_id", F.array_join("terms", " ").alias("terms"))


# index


@query
def postings(spark, sf_dir):
    return plain_index(spark, sf_dir).postings


@query
def term_df(spark, sf_dir):
    return plain_index(spark, sf_dir).document_frequencies()


@query
def doc_length(spark, sf_dir):
    return plain_index(spark, sf_dir).doc_stats


@query
def avg_doc_length(spark, sf_dir):
    return plain_index(spark, sf_dir).average_length().select(F.round("avg_doc_len", 6).alias("avg_doc_len"))


@query
def vocab_size(spark, sf_dir):
    return plain_index(spark, sf_dir).vocabulary_size()


@query
def doc_count(spark, sf_dir):
    return plain_index(spark, sf_dir).document_count()


@query
def posting_list_term(spark, sf_dir):
    return plain_index(spark, sf_dir).posting_list(c.TERM)


@query
def tf_lookup(spark, sf_dir):
    asked = spark.createDataFrame(c.LOOKUPS, "doc_id long, term string")
    return plain_index(spark, sf_dir).term_frequencies(asked)


@query
def doc_lookup(spark, sf_dir):
    asked = spark.createDataFrame([(i,) for i in c.IDS], "doc_id long")
    index = plain_index(spark, sf_dir)
    return index.texts(asked).join(index.lengths(asked), "doc_id")


@query
def index_from_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.collect_list("role").alias("terms"))
    return TextIndex.from_terms(docs, PLAIN).postings


# boolean


def _boolean(name: str, text: str):
    def run(spark, sf_dir):
        return boolean.boolean_query(plain_index(spark, sf_dir), text)

    run.__name__ = name
    return query(run)


for _name, _text in c.BOOLEAN.items():
    _boolean(_name, _text)


@query
def bool_and_terms(spark, sf_dir):
    return boolean.search_and(plain_index(spark, sf_dir), list(c.AND_TERMS))


@query
def bool_or_terms(spark, sf_dir):
    return boolean.search_or(plain_index(spark, sf_dir), list(c.OR_TERMS))


@query
def bool_not_term(spark, sf_dir):
    index = plain_index(spark, sf_dir)
    return boolean.search_not(index, c.TERM, documents(spark, sf_dir).where("lang = 'en'").select("doc_id"))


@query
def bool_and_not_terms(spark, sf_dir):
    return boolean.search_and_not(plain_index(spark, sf_dir), list(c.AND_TERMS), [c.NEGATED])


@query
def bool_set_algebra(spark, sf_dir):
    index = plain_index(spark, sf_dir)
    a, b = (boolean.search_term(index, t) for t in c.AND_TERMS)
    parts = {"intersect": boolean.intersect(a, b), "union": boolean.unite(a, b), "complement": boolean.complement(index, a)}
    rows = [df.select(F.lit(k).alias("operation"), "doc_id") for k, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def bool_ranked_topk(spark, sf_dir):
    return rounded(boolean.ranked_boolean_query(plain_index(spark, sf_dir), c.RANKED_BOOLEAN, c.TOP_K))


@query
def bool_stemmed(spark, sf_dir):
    return boolean.boolean_query(stemmed_index(spark, sf_dir), c.STEMMED_BOOLEAN)


@query
def bool_batch(spark, sf_dir):
    asked = {i: text for i, text in enumerate(c.BOOLEAN.values())}
    return boolean.batch_boolean(plain_index(spark, sf_dir), asked)


# ranking


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({col: F.round(col, 8) for col in cols or ("score",)})


@query
def tfidf_topk(spark, sf_dir):
    return rounded(ranking.search(plain_index(spark, sf_dir), c.QUERY, c.TOP_K))


@query
def tfidf_dup_terms(spark, sf_dir):
    return rounded(ranking.search(plain_index(spark, sf_dir), c.DUP_QUERY, c.TOP_K))


@query
def tfidf_batch_topk(spark, sf_dir):
    found = ranking.batch_search(plain_index(spark, sf_dir), {i: q.split() for i, q in enumerate(c.BATCH)}, c.TOP_K)
    return rounded(found.withColumn("rank", F.col("rank").cast("long")))


@query
def term_weights(spark, sf_dir):
    return rounded(ranking.term_weights(plain_index(spark, sf_dir), list(c.WEIGHTED)), "idf")


@query
def term_scores(spark, sf_dir):
    return rounded(ranking.term_scores(plain_index(spark, sf_dir)), "tf_norm", "idf", "tfidf")


@query
def tfidf_hydrated(spark, sf_dir):
    hits = ranking.hydrate(ranking.search(plain_index(spark, sf_dir), c.QUERY, c.TOP_K), documents(spark, sf_dir), 100)
    return rounded(hits.select("doc_id", "score", "source", "snippet"))


@query
def format_hits(spark, sf_dir):
    hits = ranking.hydrate(ranking.search(plain_index(spark, sf_dir), c.QUERY, c.TOP_K), documents(spark, sf_dir))
    return ingest.as_text(hits.withColumn("title", F.col("source"))).select("doc_id", "line")


@query
def snippets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.concat(F.substring("text", 1, 500), F.lit("...")).alias("snippet"))


# Zipf


@query
def zipf_ranked(spark, sf_dir):
    return zipf.ranked_frequencies(zipf.word_frequencies(documents(spark, sf_dir)))


@query
def zipf_summary(spark, sf_dir):
    s = zipf.analyze(zipf.word_frequencies(documents(spark, sf_dir))).summary
    return rounded(s, "type_token_ratio", "exponent", "correlation")


@query
def zipf_top_expected(spark, sf_dir):
    return rounded(zipf.analyze(zipf.word_frequencies(documents(spark, sf_dir))).top, "expected", "ratio")


@query
def zipf_verify(spark, sf_dir):
    return zipf.verify_law(zipf.analyze(zipf.word_frequencies(documents(spark, sf_dir)), 30).top)


@query
def zipf_frequency_of(spark, sf_dir):
    asked = spark.createDataFrame([(w,) for w in c.ASKED_WORDS], "word string")
    return zipf.frequency_of(zipf.word_frequencies(documents(spark, sf_dir)), asked)


@query
def type_token_ratio(spark, sf_dir):
    return rounded(zipf.type_token_ratio(zipf.word_frequencies(documents(spark, sf_dir))), "type_token_ratio")


# metrics and evaluation


def labelled_run(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A batch ranking, and its grades by the documents' quality labels."""
    ranked = ranking.batch_search(plain_index(spark, sf_dir), {i: q.split() for i, q in enumerate(c.BATCH)}, c.EVAL_K)
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("grade"))
    return ranked, evaluation.graded_by_document(ranked, quality)


def _metric(name: str, metric: str):
    def run(spark, sf_dir):
        rows = metrics.query_metrics(labelled_run(spark, sf_dir)[1], c.KS, evaluation.MAX_GRADE)
        return rounded(rows.where(F.col("metric") == metric).select("query_id", "k", "value"), "value")

    run.__name__ = name
    return query(run)


for _name, _metric_name in c.METRIC_QUERIES.items():
    _metric(_name, _metric_name)


@query
def metrics_avg(spark, sf_dir):
    rows = metrics.query_metrics(labelled_run(spark, sf_dir)[1], c.KS, evaluation.MAX_GRADE)
    queries_ = spark.createDataFrame([(i,) for i in range(len(c.BATCH) + 1)], "query_id long")  # the last finds nothing
    return rounded(metrics.average_metrics(metrics.complete(rows, queries_, c.KS)), "value")


@query
def metrics_text(spark, sf_dir):
    rows = metrics.query_metrics(labelled_run(spark, sf_dir)[1], c.KS, evaluation.MAX_GRADE)
    return metrics.metrics_cells(metrics.average_metrics(rows).withColumn("value", F.round("value", 4)))


@query
def eval_k_grid(spark, sf_dir):
    return spark.createDataFrame([(n, k) for n in c.GRID for k in evaluation.k_values(n)], "top_k long, k long")


@query
def eval_synthetic_queries(spark, sf_dir):
    """Every word of every synthetic query, with the place of the word in the fixed list."""
    rows = [(q, w, evaluation.COMMON_WORDS.index(w)) for q, text in evaluation.synthetic_queries(50).items() for w in text.split()]
    words_ = spark.createDataFrame(rows, "query_id long, word string, place long")
    return words_.groupBy("query_id").agg(F.count("*").between(1, 3).alias("one_to_three"), (F.countDistinct("word") == F.count("*")).alias("no_repeat"))


@query
def metrics_spread(spark, sf_dir):
    rows = metrics.query_metrics(labelled_run(spark, sf_dir)[1], c.KS, evaluation.MAX_GRADE)
    return rounded(metrics.spread(rows), "mean", "min", "max", "stdev")


@query
def eval_synthetic_grades(spark, sf_dir):
    ranked = ranking.batch_search(plain_index(spark, sf_dir), {i: q.split() for i, q in enumerate(c.BATCH)}, c.EVAL_K)
    return evaluation.pseudo_grades(ranked).withColumn("grade", F.col("grade").cast("long"))


@query
def eval_labels(spark, sf_dir):
    ranked, graded = labelled_run(spark, sf_dir)
    return graded.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("grade").cast("long").alias("grade"))


# ingest and store


@query
def ingest_records(spark, sf_dir):
    """Documents as JSON lines, with other lines between them, read back by their aliases."""
    whole = F.struct(F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("content"), F.col("source").alias("name"), F.col("lang").alias("poet"))
    lines = documents(spark, sf_dir).select(F.explode(F.array(F.to_json(whole), F.lit(""), F.lit("not json"))).alias("value"))
    return ingest.extract_documents(ingest.parse_lines(lines))


@query
def ingest_numbered(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("external_id"), "text")
    return ingest.number_documents(rows).select("external_id", F.col("doc_id").cast("long").alias("doc_id"))


def _stored(name: str, options: StoreOptions):
    def run(spark, sf_dir):
        docs = documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("title"))
        return unpack_documents(pack_documents(docs, options))

    run.__name__ = name
    return query(run)


_stored("store_compressed", StoreOptions(compress=True))
_stored("store_nothing", StoreOptions(documents=False, titles=False))


# codec


@query
def lzw_roundtrip(spark, sf_dir):
    packed = lzw.compress_text(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", lzw.decompress_text(packed).alias("text"))


@query
def lzw_ratio(spark, sf_dir):
    raw = F.col("text").cast("binary")
    sizes = documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.octet_length(lzw.lzw_compress(raw)).cast("long").alias("packed"))
    return sizes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
