"""Text to terms: tokenize, then lemmatize, stem, or neither."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lemma import Lexicon, lemmatize_words
from ..functions.stem import stem_words
from ..functions.strings import to_lower
from ..functions.tokens import TokenOptions, token_texts, words


@dataclass(frozen=True)
class PipelineOptions:
    """Lemmas win over stems if both are on. Word lengths are checked before stemming."""

    lower: bool = True
    stem: bool = True
    lemmatize: bool = False
    skip_punctuation: bool = True
    skip_numbers: bool = True
    min_length: int = 2
    max_length: int = 100
    lexicon: Lexicon | None = field(default=None, compare=False)

    def tokens(self) -> TokenOptions:
        return TokenOptions(self.lower, True, self.skip_punctuation, self.skip_numbers, self.min_length, self.max_length)


class TextPipeline:
    def __init__(self, options: PipelineOptions = PipelineOptions()):
        self.options = options

    def tokenize(self, text):
        """Column of the tokens of a text, without stemming."""
        o = self.options.tokens()
        return words(text, o) if o.skip_punctuation and o.skip_numbers else token_texts(text, o)

    def normalize(self, vocabulary: DataFrame, col: str = "word", out: str = "term") -> DataFrame:
        """Adds the term of single words: lower case, then lemma or stem. No tokenizing, no length limits."""
        o = self.options
        if o.lemmatize:
            return lemmatize_words(vocabulary, o.lexicon, col, out)
        if o.stem:
            return stem_words(vocabulary, col, out)
        return vocabulary.withColumn(out, to_lower(F.col(col)) if o.lower else F.col(col))

    def plain(self) -> bool:
        """Words are terms as they are tokenized."""
        return not (self.options.stem or self.options.lemmatize)

    def term_counts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, term, tf): one explode and one partial aggregate; the vocabulary alone is stemmed, then joined."""
        tokens = docs.select(F.col(id_col).alias("doc_id"), self.tokenize(F.col(text_col)).alias("words"))
        counts = tokens.select("doc_id", F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
        if self.plain():
            return counts.select("doc_id", F.col("word").alias("term"), "tf")
        # the aggregate keeps filters on terms from being rewritten into filters on the whole chain of stemming steps
        terms = self.normalize(counts.select("word").distinct()).groupBy("word").agg(F.max("term").alias("term"))
        return counts.join(terms, "word").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))

    def terms(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, terms array<string>) in the order of the text."""
        rows = docs.select(F.col(id_col).alias("doc_id"), self.tokenize(F.col(text_col)).alias("words"))
        if self.plain():
            return rows.withColumnRenamed("words", "terms")
        flat = rows.select("doc_id", F.posexplode_outer("words").alias("at", "word"))
        named = flat.join(self.normalize(flat.select("word").where("word IS NOT NULL").distinct()), "word", "left")
        listed = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "term")))).alias("t"))
        return listed.select("doc_id", F.transform("t", lambda x: x["term"]).alias("terms"))
