"""Tokenizer: words, numbers, blanks and single other characters, with byte offsets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .strings import to_lower

WORD = "[A-Za-z][A-Za-z0-9_-]*"
NUMBER = "[0-9][0-9.,]*"
BLANK = "[ \\t\\n\\r]+"
#: Cuts a text completely; anything else is one token per character.
ANY = f"{WORD}|{NUMBER}|{BLANK}|[\\s\\S]"


@dataclass(frozen=True)
class TokenOptions:
    lower: bool = True
    skip_blanks: bool = True
    skip_punctuation: bool = True
    skip_numbers: bool = True
    min_length: int = 1
    max_length: int = 1000


def words(text: Column, options: TokenOptions = TokenOptions()) -> Column:
    """The words alone, as an array of strings: one regular expression instead of all tokens."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    if options.lower:
        found = F.transform(found, F.lower)
    return F.filter(found, lambda w: F.length(w).between(options.min_length, options.max_length))


def token_type(t: Column) -> Column:
    return F.when(t.rlike("^[A-Za-z]"), "word").when(t.rlike("^[0-9]"), "number").when(t.rlike("^[ \\t\\n\\r]"), "blank").otherwise("punctuation")


def _kept(t: Column, o: TokenOptions) -> Column:
    kind = token_type(t)
    ok = F.when(kind == "word", F.octet_length(t).between(o.min_length, o.max_length))
    return ok.when(kind == "number", F.lit(not o.skip_numbers)).when(kind == "blank", F.lit(not o.skip_blanks)).otherwise(F.lit(not o.skip_punctuation))


def _cased(t: Column, o: TokenOptions) -> Column:
    return F.when(t.rlike("^[A-Za-z]"), to_lower(t)).otherwise(t) if o.lower else t


def token_texts(text: Column, options: TokenOptions = TokenOptions()) -> Column:
    """All kept tokens as an array of strings. Length limits hold for words alone."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.transform(F.filter(found, lambda t: _kept(t, options)), lambda t: _cased(t, options))


def token_rows(docs: DataFrame, options: TokenOptions = TokenOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seq, token, position, length, token_type): every kept token of every text; position and length in bytes
    of UTF-8. A character beyond ASCII is one punctuation token.

    Offsets are running sums in a window of one text: linear in its length, and a text is a task's smallest share.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("seq", "token")).withColumn("length", F.octet_length("token").cast("long"))
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("position", F.coalesce(F.sum("length").over(before), F.lit(0)))
    t = F.col("token")
    return rows.where(_kept(t, options)).select("doc_id", F.col("seq").cast("long").alias("seq"), _cased(t, options).alias("token"), "position", "length", token_type(t).alias("token_type"))
