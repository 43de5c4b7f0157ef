"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from .chat_format import ChatTemplate
from .quality_rules import RULES, SPACES

_WORDS = f"list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '')"


def _op9(reach: float = 3.0, min_rows: int = 30) -> str:
    ratio = {
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)",
        "upper_share": "n_upper / greatest(word_chars, 1)",
    }
    bound = lambda r, p: f"quantile_disc({r}, 0.75) + {reach!r} * greatest(quantile_disc({r}, 0.75) - quantile_disc({r}, 0.25), {RULES[r]!r}) AS {p}_{r}"
    some = lambda p: ", ".join(bound(r, p) for r in RULES)
    passes = " AND ".join(f"{r} <= coalesce(s_{r}, l_{r}, a_{r})" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, text, {_WORDS} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep GROUP BY 1),
c AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {', '.join(f'{e} AS {k}' for k, e in ratio.items())} FROM c),
s AS (SELECT lang AS sl, source AS ss, {some('s')} FROM m WHERE NOT base_failed GROUP BY 1, 2 HAVING count(*) >= {min_rows}),
l AS (SELECT lang AS ll, {some('l')} FROM m WHERE NOT base_failed GROUP BY 1 HAVING count(*) >= {min_rows}),
a AS (SELECT {some('a')} FROM m WHERE NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passes} AS kept
FROM m LEFT JOIN s ON lang IS NOT DISTINCT FROM sl AND source IS NOT DISTINCT FROM ss LEFT JOIN l ON lang IS NOT DISTINCT FROM ll CROSS JOIN a
"""


def _op10() -> str:
    t = ChatTemplate()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    marks = lambda col: f"len(regexp_extract_all({col}, {quoted(t.pattern())}))"
    known = " ".join(f"WHEN role = {quoted(r)} THEN {len(s.prefix) + len(s.suffix)}" for r, s in t.roles.items())
    other = f"{len(t.other.prefix) + len(t.other_as) + len(t.other.suffix)} + length(role) + {marks('role')}"
    loss = ", ".join(quoted(r) for r, s in t.roles.items() if s.loss)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role IN ({loss})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({loss})), '')) AS loss_sha256,
  ({len(t.bos)} + sum(length(text) + {marks('text')} + CASE {known} ELSE {other} END))::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM t GROUP BY conv_id
"""


def _op7(min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 1.5, least_pages: int = 10) -> str:
    """Listed rules by a row each; mined rules by counting every combination of the tokens that are frequent in bad URLs."""
    parts = r"'(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    named = lambda prefix, list_: f"list_transform(list_filter({list_}, lambda x: x <> ''), lambda x: '{prefix}' || x)"
    segments = "list_filter(regexp_split_to_array(lower(path), '[/.]'), lambda x: NOT regexp_full_match(x, '[0-9]*'))"
    keys = "list_transform(string_split(query, '&'), lambda x: split_part(x, '=', 1))"
    tokens = f"list_sort(list_distinct(list_concat(list_concat({named('h:', 'string_split(host, chr(46))')}, {named('p:', segments)}), {named('q:', keys)})))"
    return f"""
WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, {parts}, 1), ''), '{upper}', '{lower}') AS host,
  coalesce(regexp_extract(url, {parts}, 2), '') AS path, coalesce(regexp_extract(url, {parts}, 3), '') AS query FROM pages),
t AS (SELECT *, CASE WHEN url IS NOT NULL THEN {tokens} END AS tokens FROM u),
bad AS (SELECT doc_id, (min(quality) = 0 OR max(toxic) = 1) AS bad FROM labels GROUP BY 1),
bags AS (SELECT tokens, bad, row_number() OVER () AS bag FROM t JOIN bad ON page_id = doc_id WHERE bad IS NOT NULL AND len(tokens) > 0),
total AS (SELECT count(*) AS n, count(*) FILTER (bad) AS n_bad, ceil(greatest({min_support!r}, {least_pages} / count(*)) * count(*)) AS least FROM bags),
often AS (SELECT token FROM (SELECT unnest(tokens) AS token, bad FROM bags) WHERE bad GROUP BY 1 HAVING count(*) >= (SELECT least FROM total)),
slim AS (SELECT bag, bad, list_sort(list(token)) AS own FROM (SELECT bag, bad, unnest(tokens) AS token FROM bags) WHERE token IN (SELECT token FROM often) GROUP BY 1, 2),
subsets AS (SELECT bad, list_filter(own, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM (SELECT bad, own, unnest(range(1, (1 << len(own))::BIGINT)) AS mask FROM slim)),
counted AS (SELECT items, count(*) AS n_items, count(*) FILTER (bad) AS n_both FROM subsets GROUP BY 1),
mined AS (SELECT items, n_both / n_items AS confidence, n_both / n AS support FROM counted, total
  WHERE n_both >= least AND n_both / n_items >= {min_confidence!r} AND (n_both / n_items) / (n_bad / n) >= {min_lift!r}),
rules AS (SELECT * FROM mined m WHERE len(items) = 1 OR NOT EXISTS (SELECT 1 FROM mined s WHERE len(s.items) = 1 AND list_contains(m.items, s.items[1]) AND s.confidence >= m.confidence)),
fits AS (SELECT page_id, url, items, confidence, row_number() OVER (PARTITION BY page_id, url ORDER BY confidence DESC, support DESC, items) AS place
  FROM (SELECT DISTINCT page_id, url, tokens FROM t) JOIN rules ON list_has_all(tokens, items)),
listed(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (SELECT page_id, url, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS v
  FROM (SELECT DISTINCT page_id, url, host, path FROM t) JOIN listed ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1, 2, 3, 4)
SELECT t.page_id, t.host, t.path, j.rule, coalesce(j.v, CASE WHEN f.items IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(f.items, ' & ') AS mined_rule, f.confidence
FROM t LEFT JOIN judged j ON t.page_id IS NOT DISTINCT FROM j.page_id AND t.url IS NOT DISTINCT FROM j.url
  LEFT JOIN fits f ON t.page_id IS NOT DISTINCT FROM f.page_id AND t.url = f.url AND f.place = 1
"""


ORACLE_SQL = {"op7_url_filter": _op7(), "op9_quality_rules": _op9(), "op10_chat_format": _op10()}
