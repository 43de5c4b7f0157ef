"""What an index keeps of its documents: texts or none, compressed or plain, titles or none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lzw import lzw_compress, lzw_decompress


@dataclass(frozen=True)
class StoreOptions:
    documents: bool = True
    compress: bool = False
    titles: bool = True


def pack_documents(docs: DataFrame, options: StoreOptions = StoreOptions()) -> DataFrame:
    """The stored form of documents (doc_id, text, and title if there is one): ``packed`` instead of ``text`` if they
    are compressed, neither if texts aren't kept."""
    out = docs if options.titles or "title" not in docs.columns else docs.drop("title")
    if not options.documents:
        return out.drop("text")
    return out.withColumn("packed", lzw_compress(F.col("text").cast("binary"))).drop("text") if options.compress else out


def unpack_documents(stored: DataFrame) -> DataFrame:
    """Documents with ``text``, and ``title``, out of any stored form; what wasn't kept is empty."""
    out = stored
    if "packed" in out.columns:
        out = out.withColumn("text", F.decode(lzw_decompress("packed"), "UTF-8")).drop("packed")
    elif "text" not in out.columns:
        out = out.withColumn("text", F.lit(""))
    return out if "title" in out.columns else out.withColumn("title", F.lit(""))
