"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from collections import Counter

from ..functions.lemma import base_lexicon
from ..functions.stem import stem_sql
from ..functions.strings import PUNCTUATION
from ..functions.tokens import ANY, WORD
from . import constants as c


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(terms) -> str:
    return ", ".join(map(quoted, terms))


def _words(col: str, most: int = 100) -> str:
    return f"list_filter(list_transform(regexp_extract_all({col}, '{WORD}'), lambda x: lower(x)), lambda x: length(x) BETWEEN 2 AND {most})"


POST = f"""w AS (SELECT doc_id, unnest({_words('text')}) AS term FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY 1, 2)"""
STATS = """stats AS (SELECT d.doc_id, coalesce(sum(tf), 0)::BIGINT AS doc_len FROM documents d LEFT JOIN post USING (doc_id) GROUP BY 1)"""
IDF = """idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM post GROUP BY 1)"""


def scores(batch: list[list[str]], post: str = POST) -> str:
    rows = ", ".join(f"({i}, {quoted(t)}, {n})" for i, q in enumerate(batch) for t, n in Counter(q).items())
    return f"""{post}, {STATS}, {IDF}, q(query_id, term, qtf) AS (VALUES {rows}),
s AS (SELECT query_id, doc_id, sum(qtf * tf / doc_len * idf) AS score FROM q JOIN post USING (term) JOIN idf USING (term) JOIN stats USING (doc_id) GROUP BY 1, 2)"""


def top(batch: list[str], extra: str = "round(score, 8) AS score", post: str = POST) -> str:
    return f"WITH {scores([batch], post)} SELECT doc_id, {extra} FROM s ORDER BY s.score DESC, doc_id LIMIT {c.TOP_K}"


def _has(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM post WHERE term = {quoted(term)})"


def boolean(where: str) -> str:
    return f"WITH {POST} SELECT doc_id FROM documents WHERE {where}"


BOOLEAN = {
    "bool_term": _has("that"),
    "bool_and": f"{_has('that')} AND {_has('with')}",
    "bool_or": f"{_has('that')} OR {_has('with')}",
    "bool_not": f"NOT {_has('that')}",
    "bool_and_not": f"{_has('that')} AND NOT {_has('with')}",
    "bool_nested": f"({_has('that')} OR {_has('from')}) AND NOT ({_has('with')} OR {_has('tion')})",
    "bool_strength": f"{_has('that')} OR ({_has('from')} AND {_has('with')})",
    "bool_last_operand": _has("with"),
    "bool_malformed": "false",
    "bool_open_parenthesis": f"{_has('that')} OR {_has('with')}",
}

FREQ = f"""z AS (SELECT unnest({_words('text', 1000)}) AS word FROM documents), freq AS (SELECT word, count(*) AS freq FROM z GROUP BY 1),
ranked AS (SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) AS rank FROM freq),
fit AS (SELECT * FROM ranked WHERE rank <= 100),
line AS (SELECT coalesce(-regr_slope(ln(freq), ln(rank)), 1.0) AS exponent, max(freq)::DOUBLE AS zipf_constant FROM fit),
top AS (SELECT word, freq, rank, zipf_constant / pow(rank, exponent) AS expected, freq / (zipf_constant / pow(rank, exponent)) AS ratio FROM ranked, line)"""

BATCH = [q.split() for q in c.BATCH]
RANKED = f"""{scores(BATCH)}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""
GRADED = f"""{RANKED}, quality AS (SELECT doc_id, max(quality) AS grade FROM labels GROUP BY 1),
g AS (SELECT query_id, rank, coalesce(grade, 0)::BIGINT AS grade FROM r LEFT JOIN quality USING (doc_id) WHERE rank <= {c.EVAL_K})"""
METRIC = f"""{GRADED}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal, (pow(2, grade) - 1) / 4 AS stop FROM g),
y AS (SELECT *, coalesce(product(1 - stop) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS stays FROM x),
ks AS (SELECT unnest({c.KS})::BIGINT AS k),
v AS (SELECT query_id, k, avg((grade > 0)::INT) FILTER (rank <= k) AS p, coalesce(sum(grade / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg,
  coalesce(sum(grade / log2(ideal + 1)) FILTER (ideal <= k), 0) AS idcg, coalesce(sum(stays * stop / rank) FILTER (rank <= k), 0) AS err FROM y, ks GROUP BY 1, 2),
m AS (SELECT query_id, 'P' AS metric, k, p AS value FROM v UNION ALL SELECT query_id, 'DCG', k, dcg FROM v
  UNION ALL SELECT query_id, 'NDCG', k, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END FROM v UNION ALL SELECT query_id, 'ERR', k, err FROM v)"""

STEMMED = f"""voc AS (SELECT DISTINCT unnest({_words('text')}) AS word FROM documents), {stem_sql('voc')}"""
STEM_POST = f"""{STEMMED}, w AS (SELECT doc_id, unnest({_words('text')}) AS word FROM documents),
post AS (SELECT stem AS term, doc_id, count(*) AS tf FROM w JOIN stems USING (word) GROUP BY 1, 2)"""
# the stems of STEM_QUERY
STEM_TERMS = ["relat", "heat", "thin"]

ORACLE_SQL: dict[str, str] = {
    "tokenize_words": f"SELECT doc_id, len({_words('text')})::BIGINT AS n_words, array_to_string({_words('text')}, ' ') AS words FROM documents",
    "tokenize_pages": f"SELECT page_id, len({_words('html')})::BIGINT AS n_words, array_to_string({_words('html')}, ' ') AS words FROM pages",
    "token_offsets": f"""WITH t AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{ANY}') AS l FROM documents)),
o AS (SELECT *, coalesce(sum(strlen(token)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM t)
SELECT doc_id, lower(token) AS token, position, strlen(token)::BIGINT AS length FROM o WHERE regexp_matches(token, '^[A-Za-z]') AND strlen(token) <= 1000""",
    "token_types": f"""WITH t AS (SELECT page_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '{ANY}') AS l FROM pages)),
o AS (SELECT page_id AS doc_id, token, coalesce(sum(strlen(token)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM t)
SELECT doc_id, CASE WHEN regexp_matches(token, '^[A-Za-z]') THEN 'word' WHEN regexp_matches(token, '^[0-9]') THEN 'number' WHEN regexp_matches(token, '^[ \\t\\n\\r]') THEN 'blank' ELSE 'punctuation' END AS token_type,
count(*) AS n, sum(strlen(token))::BIGINT AS bytes, max(position) AS last_position FROM o WHERE NOT regexp_matches(token, '^[A-Za-z]') OR strlen(token) <= 1000 GROUP BY 1, 2""",
    "token_counts_by_lang": f"SELECT lang, sum(len({_words('text')}))::BIGINT AS n_words, count(*) AS n_docs FROM documents GROUP BY 1",
    "str_case": "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS upper FROM documents",
    "str_normalize": "SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS normal FROM documents",
    "str_remove_punct": f"SELECT doc_id, translate(text, {quoted(PUNCTUATION)}, '') AS bare FROM documents",
    "str_trim": "SELECT doc_id, trim(' ' || chr(9) || text || chr(13) || chr(10) || ' ', ' ' || chr(9) || chr(10) || chr(13)) AS trimmed FROM documents",
    "str_split_join": "WITH p AS (SELECT doc_id, list_filter(string_split(text, '.'), lambda x: x <> '') AS parts FROM documents) SELECT doc_id, len(parts)::BIGINT AS n_parts, array_to_string(parts, ', ') AS joined FROM p",
    "str_find": """SELECT doc_id, (strpos(text, 'the') - 1)::BIGINT AS first_the, CASE WHEN strpos(substring(text, 21), 'the') > 0 THEN strpos(substring(text, 21), 'the') + 19 ELSE -1 END::BIGINT AS later_the,
CASE WHEN strpos(text, 'a') > 0 THEN length(regexp_extract(text, '(?s)^(.*)a', 1)) ELSE -1 END::BIGINT AS last_a FROM documents""",
    "str_prefix_suffix": "SELECT doc_id, starts_with(text, 'Th') AS starts, ends_with(text, '.') AS ends, substring(text, 4, 5) AS part, strlen(text)::BIGINT AS bytes, text < 'M' AS before_m FROM documents",
    "str_append": "SELECT doc_id, coalesce(text, '') || ' ' || coalesce(source, '') || repeat('!', 3) AS longer FROM documents",
    "str_numbers": "SELECT l_orderkey, l_linenumber, l_orderkey::VARCHAR AS key_text, printf('%.2f', floor(l_extendedprice::DOUBLE / 7 * 100) / 100) AS price_text FROM lineitem",
    "hex_roundtrip": "SELECT doc_id, (2 * strlen(text))::BIGINT AS n_digits, text FROM documents",
    "stem_vocab": f"WITH {STEMMED} SELECT word, stem FROM stems",
    "stem_postings": f"WITH {STEM_POST} SELECT doc_id, term, tf FROM post",
    "stem_tfidf_topk": top(STEM_TERMS, post=STEM_POST),
    "lemma_vocab": f"WITH {STEMMED}, lex(form, lemma) AS (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in sorted(base_lexicon().items()))}) SELECT word, coalesce(lemma, stem) AS lemma FROM stems LEFT JOIN lex ON word = form",
    "pipeline_terms": f"SELECT doc_id, array_to_string({_words('text')}, ' ') AS terms FROM documents",
    "postings": f"WITH {POST} SELECT term, doc_id, tf FROM post",
    "term_df": f"WITH {POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1",
    "doc_length": f"WITH {POST}, {STATS} SELECT doc_id, doc_len FROM stats",
    "avg_doc_length": f"WITH {POST}, {STATS} SELECT round(avg(doc_len), 6) AS avg_doc_len FROM stats",
    "vocab_size": f"WITH {POST} SELECT count(DISTINCT term) AS n_terms FROM post",
    "doc_count": "SELECT count(*) AS n_docs FROM documents",
    "posting_list_term": f"WITH {POST} SELECT doc_id, tf FROM post WHERE term = {quoted(c.TERM)}",
    "tf_lookup": f"WITH {POST}, a(doc_id, term) AS (VALUES {', '.join(f'({i}::BIGINT, {quoted(t)})' for i, t in c.LOOKUPS)}) SELECT doc_id, term, coalesce(tf, 0)::BIGINT AS tf FROM a LEFT JOIN post USING (doc_id, term)",
    "doc_lookup": f"WITH {POST}, {STATS}, a(doc_id) AS (VALUES {', '.join(f'({i}::BIGINT)' for i in c.IDS)}) SELECT a.doc_id, coalesce(text, '') AS text, coalesce(doc_len, 0)::BIGINT AS doc_len FROM a LEFT JOIN documents d ON a.doc_id = d.doc_id LEFT JOIN stats s ON a.doc_id = s.doc_id",
    "index_from_terms": "SELECT role AS term, conv_id AS doc_id, count(*) AS tf FROM conversations GROUP BY 1, 2",
    **{name: boolean(where) for name, where in BOOLEAN.items()},
    "bool_and_terms": boolean(" AND ".join(map(_has, c.AND_TERMS))),
    "bool_or_terms": boolean(" OR ".join(map(_has, c.OR_TERMS))),
    "bool_not_term": boolean(f"lang = 'en' AND NOT {_has(c.TERM)}"),
    "bool_and_not_terms": boolean(" AND ".join(map(_has, c.AND_TERMS)) + f" AND NOT {_has(c.NEGATED)}"),
    "bool_set_algebra": f"""WITH {POST} SELECT 'intersect' AS operation, doc_id FROM documents WHERE {' AND '.join(map(_has, c.AND_TERMS))}
UNION ALL SELECT 'union', doc_id FROM documents WHERE {' OR '.join(map(_has, c.AND_TERMS))} UNION ALL SELECT 'complement', doc_id FROM documents WHERE NOT {_has(c.AND_TERMS[0])}""",
    "bool_ranked_topk": f"""WITH {scores([['that', 'from', 'with']])}, b AS (SELECT doc_id FROM documents WHERE ({_has('that')} OR {_has('from')}) AND NOT {_has('with')})
SELECT doc_id, round(coalesce(score, 0), 8) AS score FROM b LEFT JOIN s USING (doc_id) ORDER BY coalesce(s.score, 0) DESC, doc_id LIMIT {c.TOP_K}""",
    "tfidf_topk": top(c.QUERY),
    "tfidf_dup_terms": top(c.DUP_QUERY),
    "tfidf_batch_topk": f"WITH {RANKED} SELECT query_id::BIGINT AS query_id, rank, doc_id, round(score, 8) AS score FROM r WHERE rank <= {c.TOP_K}",
    "term_weights": f"""WITH {POST}, {IDF}, a(position, term) AS (VALUES {', '.join(f'({i}::BIGINT, {quoted(t)})' for i, t in enumerate(c.WEIGHTED))})
SELECT position, term, coalesce(df, 0)::BIGINT AS df, round(coalesce(idf, 0), 8) AS idf FROM a LEFT JOIN idf USING (term)""",
    "term_scores": f"WITH {POST}, {STATS}, {IDF} SELECT term, doc_id, round(tf / doc_len, 8) AS tf_norm, tf::DOUBLE AS raw_tf, round(idf, 8) AS idf, round(tf / doc_len * idf, 8) AS tfidf FROM post JOIN idf USING (term) JOIN stats USING (doc_id)",
    "tfidf_hydrated": f"WITH {scores([c.QUERY])} SELECT doc_id, round(score, 8) AS score, source, left(text, 100) || '...' AS snippet FROM s JOIN documents USING (doc_id) ORDER BY s.score DESC, doc_id LIMIT {c.TOP_K}",
    "snippets": "SELECT doc_id, left(text, 500) || '...' AS snippet FROM documents",
    "zipf_ranked": f"WITH {FREQ} SELECT word, freq, rank FROM ranked",
    "zipf_summary": f"""WITH {FREQ} SELECT (SELECT sum(freq) FROM freq)::BIGINT AS total_words, (SELECT count(*) FROM freq) AS unique_words, round((SELECT count(*) / sum(freq) FROM freq), 8) AS type_token_ratio,
round(exponent, 8) AS exponent, zipf_constant, round((SELECT corr(ln(freq), ln(zipf_constant) - exponent * ln(rank)) FROM fit, line), 8) AS correlation FROM line""",
    "zipf_top_expected": f"WITH {FREQ} SELECT word, freq, rank, round(expected, 8) AS expected, round(ratio, 8) AS ratio FROM top WHERE rank <= 50",
    "zipf_verify": f"""WITH {FREQ}, t AS (SELECT * FROM top WHERE rank <= 30) SELECT count(*) AS n_rows, count(*) FILTER (rank <= 20 AND abs(ratio - 1) < 0.3) AS n_close,
count(*) >= 10 AND count(*) FILTER (rank <= 20 AND abs(ratio - 1) < 0.3) >= count(*) // 2 AS holds FROM t""",
    "type_token_ratio": f"WITH {FREQ} SELECT sum(freq)::BIGINT AS total_words, count(*) AS unique_words, round(count(*) / sum(freq), 8) AS type_token_ratio FROM freq",
    **{name: f"WITH {METRIC} SELECT query_id::BIGINT AS query_id, k, round(value, 8) AS value FROM m WHERE metric = '{m}'" for name, m in c.METRIC_QUERIES.items()},
    "metrics_avg": f"WITH {METRIC} SELECT metric, k, round(sum(value) / {len(c.BATCH) + 1}, 8) AS value FROM m GROUP BY 1, 2",
    "metrics_spread": f"WITH {METRIC} SELECT metric, k, round(avg(value), 8) AS mean, round(min(value), 8) AS min, round(max(value), 8) AS max, round(coalesce(stddev_samp(value), 0), 8) AS stdev FROM m GROUP BY 1, 2",
    "eval_synthetic_grades": f"""WITH {RANKED}, t AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS share FROM r WHERE rank <= {c.EVAL_K})
SELECT query_id::BIGINT AS query_id, doc_id, CASE WHEN share >= 0.8 THEN 2 WHEN share >= 0.5 THEN 1 ELSE 0 END::BIGINT AS grade FROM t""",
    "eval_labels": f"WITH {GRADED} SELECT query_id::BIGINT AS query_id, rank, grade FROM g",
    "bool_stemmed": f"WITH {STEM_POST} SELECT doc_id FROM documents WHERE ({_has('tion')} OR {_has('with')}) AND NOT {_has('than')}",
    "bool_batch": f"WITH {POST} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, doc_id FROM documents WHERE {BOOLEAN[name]}" for i, name in enumerate(c.BOOLEAN)),
    "format_hits": f"""WITH {scores([c.QUERY])} SELECT doc_id, printf('[%d] (score: %.4f) %s', doc_id, s.score, source) || chr(10) || left(text, 200) || '...' || chr(10) AS line
FROM s JOIN documents USING (doc_id) ORDER BY s.score DESC, doc_id LIMIT {c.TOP_K}""",
    "zipf_frequency_of": f"WITH {FREQ}, a(word) AS (VALUES {', '.join(f'({quoted(w)})' for w in c.ASKED_WORDS)}) SELECT word, coalesce(freq, 0)::BIGINT AS freq FROM a LEFT JOIN freq USING (word)",
    "metrics_text": f"""WITH {METRIC}, a AS (SELECT metric, k, round(avg(value), 4) AS value FROM m GROUP BY 1, 2)
SELECT metric, string_agg(printf('%.4f', value), chr(9) ORDER BY k) AS cells FROM a GROUP BY 1""",
    "eval_k_grid": """WITH t AS (SELECT unnest([5, 10, 25, 50])::BIGINT AS top_k), g AS (SELECT top_k, unnest([1, 3, 5, 10]) AS k FROM t WHERE top_k <= 10
UNION SELECT top_k, unnest(range(top_k // 10, top_k + 1, top_k // 10)) FROM t WHERE top_k > 10 UNION SELECT top_k, unnest([1, top_k]) FROM t WHERE top_k > 10) SELECT top_k, k::BIGINT AS k FROM g WHERE k <= top_k""",
    "eval_synthetic_queries": "SELECT unnest(range(1, 51))::BIGINT AS query_id, true AS one_to_three, true AS no_repeat",
    "lemma_user_entries": f"""WITH {STEMMED}, own(form, lemma) AS (VALUES ('that', 'thing'), ('ofs', 'of'), ('the', 'article')),
lex(form, lemma) AS (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in sorted(base_lexicon().items()))})
SELECT word, coalesce(own.lemma, lex.lemma, stem) AS lemma FROM stems LEFT JOIN own ON word = own.form LEFT JOIN lex ON word = lex.form""",
    "ingest_records": "SELECT doc_id::VARCHAR AS external_id, coalesce(text, '') AS text, coalesce(source, '') AS title, coalesce(lang, '') AS author, '' AS year FROM documents",
    "ingest_numbered": "SELECT doc_id::VARCHAR AS external_id, row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS doc_id FROM documents WHERE length(text) > 0",
    "store_compressed": "SELECT doc_id, text, source AS title FROM documents",
    "store_nothing": "SELECT doc_id, '' AS text, '' AS title FROM documents",
    "lzw_roundtrip": "SELECT doc_id, text FROM documents",
}
