"""The fixed terms and queries that the registered queries ask."""

from __future__ import annotations

TOP_K = 10
EVAL_K = 10
KS = [1, 3, 5, 10]
TERM, NEGATED = "with", "from"
AND_TERMS = ("that", "with")
OR_TERMS = ("from", "tion", "than")
QUERY = ["that", "with", "this"]
DUP_QUERY = ["that", "that", "from"]
STEM_QUERY = "relations heating thinned"
WEIGHTED = ("that", "zzz", "ther", "that", "from")
IDS = (0, 7, 99, 123456789)
LOOKUPS = [(0, "that"), (1, "with"), (2, "zzz"), (123456789, "that")]
BATCH = ["that with", "from than than", "ther this", "tion", "that from ther with"]
RANKED_BOOLEAN = "(that OR from) AND NOT with"
BOOLEAN = {
    "bool_term": "that",
    "bool_and": "that AND with",
    "bool_or": "that OR with",
    "bool_not": "NOT that",
    "bool_and_not": "that AND NOT with",
    "bool_nested": "(that OR from) AND NOT (with OR tion)",
    "bool_strength": "that OR from AND with",
    "bool_last_operand": "that with",
    "bool_malformed": "that AND",
    "bool_open_parenthesis": "(that OR with",
}
STEMMED_BOOLEAN = "(tioning OR withing) AND NOT thans"
USER_LEMMAS = [("that", "first"), ("That", "thing"), ("ofs", "of"), ("the", "article")]
ASKED_WORDS = ("the", "that", "zzz", "tion")
GRID = (5, 10, 25, 50)
METRIC_QUERIES = {"metric_precision": "P", "metric_dcg": "DCG", "metric_ndcg": "NDCG", "metric_err": "ERR"}
