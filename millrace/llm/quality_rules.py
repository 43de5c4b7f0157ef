"""Quality rules with adaptive thresholds: mergeable quantile sketches (KLL) per language and source.

All of it is DataFrame functions. Each text gives counts and ratios. Every (language, source) keeps one sketch per
ratio; those of a language, and of all, are merges of them. A ratio is out of bounds above ``q75 + reach * spread``,
``spread`` being the interquartile range but at least a floor. A source with too few rows takes the bounds of its
language, and a language with too few those of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Ratio, and the least spread its bound allows for.
RULES = {"symbols_per_word": 0.04, "dup_line_share": 0.15, "repeat_share": 0.15, "upper_share": 0.02}


def repeated_window_words() -> Column:
    """Positions of ``words`` that lie in a 3-word window occurring twice or more; ``windows`` holds the windows' hashes.

    ``twice`` has the repeated hashes. A few are looked up one by one; if they are many, hashes sorted with their
    positions show the repeats as neighbours, so a long text of repeats costs a sort, not a square.
    """
    few = F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda i: F.array_contains(F.col("twice"), F.col("windows")[i]))
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def neighbours(s: Column) -> Column:
        same = lambda i, j: s[i]["h"] == s[j]["h"]
        at = lambda i: F.when(((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))) | ((i < F.size(s) - 1) & same(i, F.least(i + 1, F.size(s) - 1))), s[i]["i"])
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), at), lambda p: p.isNotNull())

    many = F.transform(F.array(pairs), neighbours)[0]
    starts = F.when(F.size("twice") <= 32, few).otherwise(many)
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2))))
    return F.when(F.size("twice") == 0, F.lit(0)).otherwise(F.size(covered)).cast("long")


def text_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and n_lines, n_upper."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.col(k) for k in keep), t.alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", SPACES), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    n = F.size("words")
    word = F.col("words")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word[i], word[i + 1], word[i + 2])))
    rows = rows.select(
        "doc_id", *keep,
        n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    rows = rows.withColumn("sorted", F.sort_array("windows"))
    twice = F.array_distinct(F.filter("sorted", lambda x, i: (i > 0) & (x == F.col("sorted")[F.greatest(i - 1, F.lit(0))])))
    rows = rows.withColumn("twice", twice).drop("sorted")
    return rows.withColumn("n_repeat_words", repeated_window_words()).drop("windows", "twice")


def sketches(counts: DataFrame, k: int) -> DataFrame:
    """One row per (lang, source), with a sketch of every ratio."""
    return counts.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(r, F.lit(k)).alias(r) for r in RULES))


def bounds(merged: DataFrame, reach: float, prefix: str) -> list[Column]:
    out = []
    for r, floor in RULES.items():
        q25, q75 = (F.kll_sketch_get_quantile_double(F.col(r), F.lit(q)) for q in (0.25, 0.75))
        out.append((q75 + reach * F.greatest(q75 - q25, F.lit(floor))).alias(f"{prefix}{r}"))
    return out


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: float = 3.0, min_rows: int = 30, k: int = 4096) -> DataFrame:
    """Judges every text: doc_id, lang, source, the counts, base_failed, failed_rules (names), kept.

    Base: fewer than 50 words, or over half of the words in repeated 3-word windows. Then the adaptive bounds of the
    text's language and source. Bounds come from rows that pass the base; a (language, source) with under ``min_rows``
    of them takes its language's bounds, a language with fewer those of all rows. ``k``: size of the sketches (exact
    up to k rows, a rank error of about 2.3 / k^0.9 beyond).

    Defined results: a null text counts as empty and fails the base; null languages and sources are groups of their
    own; repeated rows and ids are judged each; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    c = text_counts(rows)
    words = F.greatest("n_words", F.lit(1))
    c = c.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_upper") / F.greatest("word_chars", F.lit(1))).alias("upper_share"),
    )
    c = saved(c, "counts")
    own = saved(sketches(c.where("NOT base_failed"), k), "sketches")
    merge = [F.kll_merge_agg_double(r, F.lit(k)).alias(r) for r in RULES]
    total = F.sum("n").alias("n")
    level = lambda df, name: df.where(F.col("n") >= (min_rows if name != "all" else 1))
    by_source = level(own, "source").select(F.col("lang").alias("l1"), F.col("source").alias("s1"), *bounds(own, reach, "s_"))
    by_lang = level(own.groupBy("lang").agg(total, *merge), "lang").select(F.col("lang").alias("l2"), *bounds(own, reach, "l_"))
    by_all = level(own.agg(total, *merge), "all").select(F.lit(1).alias("one"), *bounds(own, reach, "a_"))
    # a row of bounds for every (language, source), judged or not
    cells = c.select("lang", "source").distinct().withColumn("one", F.lit(1))
    cells = cells.join(by_source, F.expr("lang <=> l1 AND source <=> s1"), "left").join(by_lang, F.expr("lang <=> l2"), "left").join(by_all, "one", "left")
    cells = cells.select(F.col("lang").alias("cl"), F.col("source").alias("cs"), *(F.coalesce(f"s_{r}", f"l_{r}", f"a_{r}").alias(f"max_{r}") for r in RULES))
    out = c.join(cells, F.expr("lang <=> cl AND source <=> cs"), "left").drop("cl", "cs")
    failed = F.filter(F.array(*(F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    return out.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
