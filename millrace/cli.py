"""Command line: ingest JSON lines, build an index, search it.

python -m millrace.cli ingest --jsonl poems.jsonl --store /data/docs --index /data/index [--limit N]
python -m millrace.cli search --index /data/index --query "eternal love" [--mode boolean] [--top-k 5] [--format json]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.boolean import boolean_query
from .operators.index import TextIndex
from .operators.pipeline import PipelineOptions
from .operators.ranking import hydrate, search
from .sources.ingest import as_json, as_text, load_jsonl, number_documents


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    documents = spark.read.parquet(args.store) if args.skip_store else load_jsonl(spark, args.jsonl, args.store, args.limit)
    index = TextIndex.build(number_documents(documents, limit=args.limit)).save(args.index)
    count = index.documents.count()
    print(f"indexed {count} documents")
    return count


def hits_of(index: TextIndex, query: str, mode: str, top_k: int) -> DataFrame:
    if mode == "boolean":
        hits = boolean_query(index, query).limit(top_k).withColumn("score", F.lit(0.0))
    else:
        hits = search(index, query, top_k)
    title = index.documents if "title" in index.documents.columns else index.documents.withColumn("title", F.lit(""))
    return hydrate(hits, title).orderBy(F.desc("score"), "doc_id")


def show(index: TextIndex, query: str, args: argparse.Namespace) -> list[str]:
    hits = hits_of(index, query, args.mode, args.top_k)
    lines = [r["line"] for r in (as_json if args.format == "json" else as_text)(hits).select("line").collect()]  # top_k rows
    print("\n".join(lines) if lines else "nothing found")
    return lines


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("--jsonl"), one.add_argument("--store", required=True), one.add_argument("--index", required=True)
    one.add_argument("--limit", type=int), one.add_argument("--skip-store", action="store_true")
    two = commands.add_parser("search")
    two.add_argument("--index", required=True), two.add_argument("--query"), two.add_argument("--mode", choices=("tfidf", "boolean"), default="tfidf")
    two.add_argument("--top-k", type=int, default=10), two.add_argument("--format", choices=("text", "json"), default="text"), two.add_argument("--interactive", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    if args.command == "ingest":
        ingest(spark, args)
        return 0
    index = TextIndex.load(spark, args.index, PipelineOptions())
    if args.interactive:
        for line in sys.stdin:
            if line.strip().lower() in ("exit", "quit", "q"):
                break
            if line.strip():
                show(index, line.strip(), args)
    else:
        show(index, args.query or sys.stdin.readline().strip(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
