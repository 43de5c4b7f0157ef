"""Boolean retrieval: a query language of AND, OR, NOT and parentheses, planned as one aggregate.

The query becomes a tree. All its terms are read from the postings at once, one group-by makes a flag of each term per
document, and the tree is a predicate over the flags. Only a query that an absent document satisfies (a NOT that
nothing guards) reads the documents too. So a query costs one shuffle, however deep it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .index import TextIndex
from .ranking import batch_scores, score_terms

STRENGTH = {"OR": 1, "AND": 2, "NOT": 3}


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Nothing:
    pass


def lex(query: str) -> list[str]:
    """Parentheses stand alone; everything else is cut at white space, other marks stay in their word."""
    return query.replace("(", " ( ").replace(")", " ) ").split()


def operator(token: str) -> str | None:
    """AND, OR or NOT, written all in one case; 'And' is a word."""
    return token.upper() if token.upper() in STRENGTH and token in (token.upper(), token.lower()) else None


def parse(query: str):
    """The tree of a query, by operator strength; OR and AND bind to the left.

    There is no implicit AND: of two operands without an operator the last counts. A missing operand makes the whole
    query empty. Parentheses without a partner are ignored.
    """
    operands: list = []
    waiting: list[str] = []

    class Broken(Exception):
        pass

    def apply(op: str) -> None:
        if len(operands) < (1 if op == "NOT" else 2):
            raise Broken
        right = operands.pop()
        operands.append(Not(right) if op == "NOT" else (Both if op == "AND" else Either)(operands.pop(), right))

    try:
        for token in lex(query):
            op = operator(token)
            if token == "(":
                waiting.append(token)
            elif token == ")":
                while waiting and waiting[-1] != "(":
                    apply(waiting.pop())
                if waiting:
                    waiting.pop()
            elif op is None:
                operands.append(Term(token))
            else:
                while waiting and waiting[-1] != "(" and (STRENGTH[waiting[-1]] > STRENGTH[op] or op != "NOT" and STRENGTH[waiting[-1]] == STRENGTH[op]):
                    apply(waiting.pop())
                waiting.append(op)
        while waiting:
            if (op := waiting.pop()) != "(":
                apply(op)
    except Broken:
        return Nothing()
    return operands[-1] if operands else Nothing()


def words_of(tree) -> list[str]:
    if isinstance(tree, Term):
        return [tree.word]
    if isinstance(tree, Not):
        return words_of(tree.of)
    return words_of(tree.left) + words_of(tree.right) if isinstance(tree, (Both, Either)) else []


def _fold(tree, leaf: Callable, negate: Callable, both: Callable, either: Callable, none):
    if isinstance(tree, Term):
        return leaf(tree.word)
    if isinstance(tree, Not):
        return negate(_fold(tree.of, leaf, negate, both, either, none))
    if isinstance(tree, Nothing):
        return none
    left, right = (_fold(t, leaf, negate, both, either, none) for t in (tree.left, tree.right))
    return both(left, right) if isinstance(tree, Both) else either(left, right)


def boolean_query(index: TextIndex, query: str) -> DataFrame:
    """doc_id of the documents that satisfy the query, ascending."""
    tree = parse(query)
    words = words_of(tree)
    terms = dict(zip(words, index.normalized(words), strict=True))
    distinct = sorted(set(terms.values()))
    flag = {t: f"f{i}" for i, t in enumerate(distinct)}
    if isinstance(tree, Nothing):
        return index.documents.select("doc_id").where(F.lit(False))
    predicate = _fold(tree, lambda w: F.col(flag[terms[w]]), lambda a: ~a, lambda a, b: a & b, lambda a, b: a | b, F.lit(False))
    open_ = _fold(tree, lambda w: False, lambda a: not a, lambda a, b: a and b, lambda a, b: a or b, False)
    hits = index.postings.where(F.col("term").isin(distinct)).groupBy("doc_id").agg(*(F.max(F.col("term") == t).alias(f) for t, f in flag.items()))
    if open_:
        hits = index.documents.select("doc_id").join(hits, "doc_id", "left").fillna(False, list(flag.values()))
    return hits.where(predicate).select("doc_id").orderBy("doc_id")


def batch_boolean(index: TextIndex, queries: dict[int, str]) -> DataFrame:
    """(query_id, doc_id) of the documents that satisfy each query: one job, one flag a term, one predicate a query."""
    spark = index.postings.sparkSession
    trees = {q: parse(text) for q, text in queries.items()}
    words = sorted({w for t in trees.values() for w in words_of(t)})
    terms = dict(zip(words, index.normalized(words), strict=True))
    flag = {t: f"f{i}" for i, t in enumerate(sorted(set(terms.values())))}
    trees = {q: t for q, t in trees.items() if not isinstance(t, Nothing)}
    if not trees:
        return spark.createDataFrame([], "query_id long, doc_id long")
    rule = lambda t: _fold(t, lambda w: F.col(flag[terms[w]]), lambda a: ~a, lambda a, b: a & b, lambda a, b: a | b, F.lit(False))
    open_ = any(_fold(t, lambda w: False, lambda a: not a, lambda a, b: a and b, lambda a, b: a or b, False) for t in trees.values())
    hits = index.postings.where(F.col("term").isin(list(flag))).groupBy("doc_id").agg(*(F.max(F.col("term") == t).alias(f) for t, f in flag.items()))
    if open_:
        hits = index.documents.select("doc_id").join(hits, "doc_id", "left").fillna(False, list(flag.values()))
    found = F.array_compact(F.array(*(F.when(rule(t), F.lit(q).cast("long")) for q, t in trees.items())))
    return hits.select(F.explode(found).alias("query_id"), "doc_id")


def batch_ranked_boolean(index: TextIndex, queries: dict[int, str], k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): ``ranked_boolean_query`` of many queries, in one job."""
    terms = index.batch_terms({q: " ".join(rank_words(text)) for q, text in queries.items()})
    rows = batch_boolean(index, queries).join(batch_scores(index, terms), ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


# the algebra on lists of documents (DataFrames of doc_id)


def search_term(index: TextIndex, term: str) -> DataFrame:
    return index.posting_list(term).select("doc_id")


def search_and(index: TextIndex, terms: list[str]) -> DataFrame:
    """Documents with all terms; none for no terms. One aggregate, not a join per term."""
    wanted = sorted(set(terms))
    return index.postings.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == max(1, len(wanted))).select("doc_id")


def search_or(index: TextIndex, terms: list[str]) -> DataFrame:
    return index.postings.where(F.col("term").isin(sorted(set(terms)))).select("doc_id").distinct()


def search_not(index: TextIndex, term: str, universe: DataFrame) -> DataFrame:
    return universe.join(search_term(index, term), "doc_id", "left_anti")


def search_and_not(index: TextIndex, include: list[str], exclude: list[str]) -> DataFrame:
    return search_and(index, include).join(search_or(index, exclude), "doc_id", "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def unite(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def complement(index: TextIndex, a: DataFrame) -> DataFrame:
    return index.documents.select("doc_id").join(a, "doc_id", "left_anti")


def rank_words(query: str) -> list[str]:
    """The words a boolean query is ranked by: all but operators and parentheses, lower-cased; negated ones too."""
    return [w for w in lex(query.lower()) if w not in ("and", "or", "not", "(", ")")]


def ranked_boolean_query(index: TextIndex, query: str, k: int = 10) -> DataFrame:
    """(doc_id, score) of the matches, best first: by TF-IDF of the query's words, then those of score 0 by doc_id."""
    hits = boolean_query(index, query)
    terms = index.query_terms(" ".join(rank_words(query)))
    scores = score_terms(index, terms)
    ranked = hits.join(scores, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return ranked.orderBy(F.desc("score"), "doc_id").limit(k)


def flag_predicate(tree, columns: dict[str, Column]) -> Column:
    """The tree as a predicate over given columns."""
    return _fold(tree, lambda w: columns[w], lambda a: ~a, lambda a, b: a & b, lambda a, b: a | b, F.lit(False))
