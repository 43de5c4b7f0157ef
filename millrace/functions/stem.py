"""A Porter-style stemmer whose measure counts steps from a consonant to a vowel.

The rules are SQL expressions over a word ``w`` and its pattern ``p`` of C and V, applied in a chain of projections, so
that no expression grows with the number of steps. The pattern of a stem is the start of the word's pattern. The same
rules, with two functions spelt differently, run in Spark and in other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# fixed values: suffix, replacement; the first suffix that fits decides
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"), ("fulli", "ful"), ("lessli", "less"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
# fixed values: suffixes that are dropped; a suffix that fails its condition leaves the choice to the next
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]

SPARK, ANSI = "spark", "ansi"
Y_ROUNDS = 8


def _all(dialect: str, s: str, pattern: str, to: str) -> str:
    """Every match replaced; ``to`` may name group 1 as <1>."""
    return f"regexp_replace({s}, '{pattern}', '{to.replace('<1>', '$1')}')" if dialect == SPARK else f"regexp_replace({s}, '{pattern}', '{to.replace('<1>', chr(92) + '1')}', 'g')"


def pattern(dialect: str, w: str = "w") -> str:
    """C or V for every character. A y is the opposite of what stands before it, and C at the start."""
    out = _all(dialect, _all(dialect, w, "[aeiou]", "V"), "[^Vy]", "C")
    for _ in range(Y_ROUNDS // 2):
        out = _all(dialect, _all(dialect, out, "(^|V)y", "<1>C"), "Cy", "CV")
    return out


def _next_pattern() -> str:
    """The pattern of a word whose end was replaced, from the old pattern: a step changes the last four characters at most,
    and what it adds holds no y, so a y there stands where it stood."""
    n = "length(w)"
    last = [f"CASE WHEN {n} < {k} THEN '' WHEN substring(w, {n} - {k - 1}, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'V' WHEN substring(w, {n} - {k - 1}, 1) = 'y' THEN substring(p, {n} - {k - 1}, 1) ELSE 'C' END" for k in (4, 3, 2, 1)]
    return f"concat(left(p, {n} - 4), {', '.join(last)})"


def _stem(n: int) -> str:
    return f"left(p, length(p) - {n})" if n else "p"


def _measure(n: int) -> str:
    """m of the stem without the last n characters."""
    s = _stem(n)
    return f"(length({s}) - length(replace({s}, 'CV', ''))) / 2"


def _vowel(n: int) -> str:
    return f"position('V' IN {_stem(n)}) > 0"


def _ends(suffix: str) -> str:
    return f"right(w, {len(suffix)}) = '{suffix}'"


def _swap(n: int, to: str) -> str:
    cut = f"left(w, length(w) - {n})"
    return f"concat({cut}, '{to}')" if to else cut


_DOUBLE = "length(w) > 1 AND right(p, 1) = 'C' AND right(w, 1) = left(right(w, 2), 1)"
_CVC = "right(p, 3) = 'CVC' AND right(w, 1) NOT IN ('w', 'x', 'y')"
_CVC_BEFORE_E = "right(left(p, length(p) - 1), 3) = 'CVC' AND left(right(w, 2), 1) NOT IN ('w', 'x', 'y')"


def _choice(rules: list[tuple[str, str]]) -> tuple[str, str]:
    """The length of the first suffix that fits (0 if none) and what replaces it."""
    cut = " ".join(f"WHEN {_ends(a)} THEN {len(a)}" for a, _ in rules)
    add = " ".join(f"WHEN {_ends(a)} THEN '{b}'" for a, b in rules)
    return f"CASE {cut} ELSE 0 END", f"CASE {add} ELSE '' END"


#: With ``cut`` and ``add`` chosen: the replacement is made if the stem's measure is positive.
_CHOSEN = "CASE WHEN cut > 0 AND position('CV' IN left(p, length(p) - cut)) > 0 THEN concat(left(w, length(w) - cut), add) ELSE w END"
_FIRST_CV = "position('CV' IN p)"
#: The least length of a stem with a measure over 1: up to the end of the second CV.
_NEED = f"CASE WHEN {_measure(0)} > 1 THEN {_FIRST_CV} + position('CV' IN substring(p, {_FIRST_CV} + 2)) + 2 ELSE 1000000 END"


def _step4() -> str:
    ion = "right(left(w, length(w) - 3), 1) IN ('s', 't') AND "
    arms = " ".join(f"WHEN {_ends(s)} AND {ion if s == 'ion' else ''}length(w) - {len(s)} >= cut THEN {_swap(len(s), '')}" for s in STEP4)
    return f"CASE {arms} ELSE w END"


_NONE = ("0", "''")
#: (new word, whether a removed ending asks for repair, what ``cut`` and ``add`` are before)
STEPS: list[tuple[str, str, tuple[str, str]]] = [
    (f"CASE WHEN {_ends('sses')} THEN {_swap(4, 'ss')} WHEN {_ends('ies')} THEN {_swap(3, 'i')} WHEN {_ends('ss')} THEN w WHEN {_ends('s')} THEN {_swap(1, '')} ELSE w END", "0", _NONE),
    (
        f"CASE WHEN {_ends('eed')} THEN CASE WHEN {_measure(3)} > 0 THEN {_swap(3, 'ee')} ELSE w END WHEN {_ends('ed')} AND {_vowel(2)} THEN {_swap(2, '')} WHEN {_ends('ing')} AND {_vowel(3)} THEN {_swap(3, '')} ELSE w END",
        f"CASE WHEN NOT {_ends('eed')} AND ({_ends('ed')} AND {_vowel(2)} OR {_ends('ing')} AND {_vowel(3)}) THEN 1 ELSE 0 END",
        _NONE,
    ),
    (f"CASE WHEN repair = 0 THEN w WHEN {_ends('at')} OR {_ends('bl')} OR {_ends('iz')} THEN concat(w, 'e') WHEN {_DOUBLE} AND right(w, 1) NOT IN ('l', 's', 'z') THEN {_swap(1, '')} WHEN {_measure(0)} = 1 AND {_CVC} THEN concat(w, 'e') ELSE w END", "0", _NONE),
    (f"CASE WHEN {_ends('y')} AND {_vowel(1)} THEN {_swap(1, 'i')} ELSE w END", "0", _NONE),
    (_CHOSEN, "0", _choice(STEP2)),
    (_CHOSEN, "0", _choice(STEP3)),
    (_step4(), "0", (_NEED, "''")),
    (f"CASE WHEN {_ends('e')} AND ({_measure(1)} > 1 OR {_measure(1)} = 1 AND NOT ({_CVC_BEFORE_E})) THEN {_swap(1, '')} ELSE w END", "0", _NONE),
    (f"CASE WHEN {_measure(0)} > 1 AND {_DOUBLE} AND {_ends('l')} THEN {_swap(1, '')} ELSE w END", "0", _NONE),
]


def stem_words(words: DataFrame, col: str = "word", out: str = "stem") -> DataFrame:
    """Adds the stem of a column of words. Words of under 3 bytes stay as they are, in case too.

    Meant for distinct words: stem a vocabulary once and join it, never every occurrence.
    """
    kept = [f"`{c}`" for c in words.columns if c != out]
    word = f"`{col}`"
    low = f"translate({word}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    df = words.selectExpr(*kept, f"{low} AS w", "0 AS repair").selectExpr(*kept, "w", "repair", f"{pattern(SPARK)} AS p")
    for step, repair, (cut, add) in STEPS:
        if "cut" in step:
            df = df.selectExpr(*kept, "w", "repair", "p", f"{cut} AS cut", f"{add} AS add")
        df = df.selectExpr(*kept, "p", f"{step} AS w", f"{repair} AS repair").selectExpr(*kept, "w", "repair", f"{_next_pattern()} AS p")
    return df.selectExpr(*kept, f"CASE WHEN octet_length({word}) < 3 THEN {word} ELSE w END AS `{out}`")


def stem_sql(source: str, col: str = "word") -> str:
    """CTEs s0 ... and ``stems(word, stem)`` over a relation of distinct words, in ANSI-like SQL."""
    parts = [f"s0 AS (SELECT {col} AS word, lower({col}) AS w, 0 AS repair FROM {source})"]
    for i, (step, repair, (cut, add)) in enumerate(STEPS):
        parts.append(f"p{i} AS (SELECT word, w, repair, {pattern(ANSI)} AS p FROM s{i})")
        parts.append(f"c{i} AS (SELECT word, w, repair, p, {cut} AS cut, {add} AS add FROM p{i})")
        parts.append(f"s{i + 1} AS (SELECT word, {step} AS w, {repair} AS repair FROM c{i})")
    parts.append(f"stems AS (SELECT word, CASE WHEN strlen(word) < 3 THEN word ELSE w END AS stem FROM s{len(STEPS)})")
    return ",\n".join(parts)
