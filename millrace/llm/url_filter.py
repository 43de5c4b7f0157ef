"""URL filters: listed host and path rules, and rules mined from labels by Spark's FP-growth.

A labelled URL is a transaction of tokens (host labels, path segments, query keys) plus a mark if its label is bad.
FP-growth finds the token combinations that imply the mark; those of too little support, confidence or lift are
dropped. Rules are matched by an inverted index: each is filed under its rarest token, so common tokens join nothing,
and a URL that holds that token is then checked for the whole combination. Rules and URLs are joined as tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

BAD = "!bad"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?"


@dataclass(frozen=True)
class ListedRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or without '://'."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def listed(host: Column, path: Column, rules: list[ListedRule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule, verdict = F.when(fits, F.lit(str(r))).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: 'h:' host labels, 'p:' path segments that aren't numbers, 'q:' query keys."""
    host, path, query = host_of(url), path_of(url), F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    named = lambda prefix, array: F.transform(F.filter(array, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    segments = F.filter(F.split(F.lower(path), "[/.]"), lambda x: ~x.rlike("^[0-9]*$"))
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(named("h:", F.split(host, "\\.")), named("p:", segments), named("q:", keys))))


def mine_rules(urls: DataFrame, *, min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 1.5, least_pages: int = 10) -> DataFrame:
    """Rules of labelled URLs (url string, bad int): items array, confidence, lift, support, filed_under.

    Support is a share of the labelled URLs, and at least ``least_pages`` of them. A rule is dropped if it is a longer
    form of a one-token rule of no less confidence. Null URLs and labels, and URLs without tokens, are left out; a URL
    that repeats counts each time. No labelled or no bad URLs give no rules.
    """
    bags = saved(urls.where("url IS NOT NULL AND bad IS NOT NULL").select(url_tokens(F.col("url")).alias("items"), "bad").where("size(items) > 0"), "bags")
    schema = "items array<string>, confidence double, lift double, support double, filed_under string"
    n, bad = bags.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not bad:
        return urls.sparkSession.createDataFrame([], schema)
    marked = bags.select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, least_pages / n)), minConfidence=min_confidence).fit(marked)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
    rules = rules.select(F.array_sort("antecedent").alias("items"), "confidence", "lift", "support")
    single = rules.where("size(items) = 1").select(F.col("items")[0].alias("one"), F.col("confidence").alias("own"))
    longer = rules.where("size(items) > 1").withColumn("one", F.explode("items")).join(single, "one").where("own >= confidence").select("items").distinct()
    rules = rules.join(longer, "items", "left_anti")
    df = bags.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    filed = rules.withColumn("token", F.explode("items")).join(df, "token").groupBy("items").agg(F.min_by("token", F.struct("df", "token")).alias("filed_under"))
    return saved(rules.join(filed, "items").select("items", "confidence", "lift", "support", "filed_under"), "rules")


def filter_urls(pages: DataFrame, rules: list[ListedRule], mined: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every URL: page_id, host, path, rule (the listed one that fits, else null), verdict ('allow' or 'block'),
    mined_rule (tokens of the surest mined rule that fits, joined by ' & '; else null), confidence.

    A listed rule decides; where none fits, a mined one blocks; else the URL is allowed.

    Defined results: a null URL, and one without '://', has an empty host and path and is allowed unless a listed rule
    fits; of equally sure mined rules the one with more support, then the first by name counts; repeated rows and ids
    are judged each; empty pages or rules are no error; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    asked = rows.select("url").where("url IS NOT NULL").distinct().withColumn("tokens", url_tokens(F.col("url")))
    asked = asked.withColumn("filed_under", F.explode("tokens")).join(mined, "filed_under").where(F.size(F.array_except("items", "tokens")) == 0)
    surest = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "items")
    best = asked.groupBy(F.col("url").alias("__url")).agg(F.min_by(F.struct("items", "confidence"), surest).alias("m"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    out = rows.join(best, rows["url"] == best["__url"], "left").withColumn("host", host).withColumn("path", path)
    out = out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("v"), F.array_join("m.items", " & ").alias("mined_rule"), F.col("m.confidence").alias("confidence"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("v", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule", "confidence")
