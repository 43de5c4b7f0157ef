"""Word-frequency statistics and a fit of Zipf's law."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import TokenOptions, words

WORDS = TokenOptions(min_length=2)
FIT_RANKS = 100  # fixed value: ranks that the exponent and the correlation are fitted on
CHECKED, LEAST_ROWS, TOLERANCE = 20, 10, 0.3  # fixed values of the law check


def word_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq) of the words of all texts, not stemmed."""
    found = docs.select(words(F.col(text_col), WORDS).alias("w")).select(F.explode("w").alias("word"))
    return count_words(found)


def count_words(stream: DataFrame) -> DataFrame:
    """(word, freq) of a stream of words, taken as they are."""
    return stream.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("freq"))


def top_frequencies(freqs: DataFrame, n: int) -> DataFrame:
    """(word, freq, rank) of the n most frequent, ties by word: a top-n first, then ranks on n rows alone."""
    top = freqs.orderBy(F.desc("freq"), "word").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "word")).cast("long"))


def ranked_frequencies(freqs: DataFrame) -> DataFrame:
    """(word, freq, rank) of the whole vocabulary, ties by word.

    A rank is the words of higher frequencies plus the place among equals. Both parts are windows over frequencies and
    words of one frequency and first byte, so no task ranks the whole vocabulary; the table of frequencies alone, which
    grows with the square root of the text, is summed in one.
    """
    head = F.substring("word", 1, 3)
    cells = freqs.groupBy("freq", head.alias("head")).agg(F.count("*").alias("n"))
    levels = cells.groupBy("freq").agg(F.sum("n").alias("m"))
    levels = levels.withColumn("above", F.sum("m").over(Window.orderBy(F.desc("freq"))) - F.col("m")).drop("m")
    inside = Window.partitionBy("freq").orderBy("head")
    cells = cells.withColumn("before", F.sum("n").over(inside) - F.col("n")).drop("n").join(levels, "freq")
    rows = freqs.withColumn("head", head).withColumn("place", F.row_number().over(Window.partitionBy("freq", "head").orderBy("word")))
    return rows.join(cells, ["freq", "head"]).select("word", "freq", (F.col("above") + F.col("before") + F.col("place")).alias("rank"))


@dataclass
class ZipfAnalysis:
    """``summary``: one row (total_words, unique_words, type_token_ratio, zipf_constant, exponent, correlation).
    ``top``: (word, freq, rank, expected, ratio) of the top words."""

    summary: DataFrame
    top: DataFrame


def type_token_ratio(freqs: DataFrame) -> DataFrame:
    """total_words, unique_words, and their ratio (0 without words)."""
    out = freqs.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total_words"), F.count("*").alias("unique_words"))
    return out.withColumn("type_token_ratio", F.when(F.col("total_words") > 0, F.col("unique_words") / F.col("total_words")).otherwise(0.0))


def analyze(freqs: DataFrame, top_n: int = 50) -> ZipfAnalysis:
    """The fit of f = C / r^a on the first 100 ranks; C is the top frequency.

    The exponent is 1 with fewer than two words; the correlation of ln f with ln(C / r^a) is then 0.
    """
    fit = top_frequencies(freqs, FIT_RANKS)
    lf, lr = F.log("freq"), F.log("rank")
    line = fit.agg(F.coalesce(-F.regr_slope(lf, lr), F.lit(1.0)).alias("exponent"), F.max("freq").cast("double").alias("zipf_constant"))
    line = line.withColumn("zipf_constant", F.coalesce("zipf_constant", F.lit(0.0)))
    one = F.broadcast(line)  # a single row
    close = fit.join(one).agg(F.coalesce(F.corr(lf, F.log("zipf_constant") - F.col("exponent") * lr), F.lit(0.0)).alias("correlation"))
    close = close.withColumn("correlation", F.when(F.isnan("correlation"), 0.0).otherwise(F.col("correlation")))
    summary = type_token_ratio(freqs).join(one).join(F.broadcast(close))
    expected = F.col("zipf_constant") / F.pow("rank", "exponent")
    top = top_frequencies(freqs, top_n).join(one).withColumn("expected", expected).withColumn("ratio", F.col("freq") / F.col("expected"))
    return ZipfAnalysis(summary, top.select("word", "freq", "rank", "expected", "ratio"))


def verify_law(top: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row (n_rows, n_close, holds): of the first 20 analysed rows, at least half of the number of all rows
    (rounded down) have a ratio within the tolerance of 1. Under 10 rows the answer is no."""
    near = (F.col("rank") <= CHECKED) & (F.abs(F.col("ratio") - 1) < tolerance)
    out = top.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(near.cast("long")), F.lit(0)).alias("n_close"))
    return out.withColumn("holds", (F.col("n_rows") >= LEAST_ROWS) & (F.col("n_close") >= F.floor(F.col("n_rows") / 2)))


def frequency_of(freqs: DataFrame, asked: DataFrame) -> DataFrame:
    """freq of word rows, 0 if absent."""
    return asked.join(freqs, "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq"))


def report(analysis: ZipfAnalysis) -> str:
    """A text table of the summary and at most 20 top words; decimals are truncated."""

    def cut(x: float, places: int) -> str:
        power = 10**places
        return f"{int(x * power) / power:.{places}f}"

    s = analysis.summary.first()
    lines = ["=== Zipf Analysis ===", f"Total words: {s['total_words']}", f"Unique words: {s['unique_words']}", f"Zipf constant (C): {cut(s['zipf_constant'], 2)}", f"Zipf exponent (α): {cut(s['exponent'], 4)}", f"Correlation: {cut(s['correlation'], 4)}", "", "Top words:", "Rank\tFreq\tExpected\tRatio\tWord"]
    for r in analysis.top.orderBy("rank").limit(20).collect():  # 20 rows
        lines.append(f"{r['rank']}\t{r['freq']}\t{cut(r['expected'], 1)}\t\t{cut(r['ratio'], 3)}\t{r['word']}")
    return "\n".join(lines) + "\n"
