"""Mixing sources to target weights by iterative proportional fitting (raking).

All work on rows is DataFrame functions. Tokens are summed per cell (source, language, topic), where categories without a
target of their own share the class ``*``; so the cells are bounded by the targets given, not by the data. The driver
rakes the weights of these cells to the three marginals until they are met. A cell's probability is its weight over its
share of the tokens, times the largest scale at which none exceeds one: so the expected tokens meet the targets, and the
scarcest cell decides how much is kept. Every document is kept with its cell's probability, by a hash of its id: the
same document is always decided alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import inline, saved

REST = "*"
DIMS = ("source", "lang", "topic")
CELL = ["__c0", "__c1", "__c2"]
#: Default targets: src0, one source of twenty, is held to an even share even where it is the hot one; languages and
#: long texts are kept near the natural mix. Categories that a filter may empty have no target of their own: a target far
#: above what there is would shrink the whole sample.
TARGETS = {
    "source": {"src0": 0.05, REST: 0.95},
    "lang": {"en": 0.60, "de": 0.15, "fr": 0.15, "es": 0.10, REST: 0.02},
    "topic": {"long": 0.37, REST: 0.63},
}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def shape_topic(text: Column, tokens: Column) -> Column:
    """A topic for tables without one: the shape of the text. 'tabular' (many bars), 'short', 'long' or 'prose'."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(10 * bars > tokens, "tabular").when(tokens < 50, "short").when(tokens > 1000, "long").otherwise("prose")


def _class_of(col: Column, names: list[str]) -> Column:
    out = F.lit(len(names) - 1)
    for i, n in enumerate(names[:-1]):
        out = F.when(col == n, F.lit(i)).otherwise(out)
    return out


def rake(cells: dict[tuple[int, int, int], float], goals: list[list[float]], close: float = 1e-10, most_sweeps: int = 1000) -> tuple[dict[tuple[int, int, int], float], list[list[float]]]:
    """(the weights of the cells, summing to 1, the goals as scaled) after raking the ``cells`` (their tokens).

    The goals of a dimension are scaled to the categories that have tokens. Sweeps end when no marginal is off by more than
    ``close``, or no longer gets nearer, as where goals contradict each other.
    """
    weight = {c: t for c, t in cells.items() if t > 0}
    scaled = []
    for d, goal in enumerate(goals):
        there = {c[d] for c in weight}
        total = sum(g for i, g in enumerate(goal) if i in there)
        scaled.append([g / total if i in there and total > 0 else 0.0 for i, g in enumerate(goal)])
    before = float("inf")
    for _ in range(most_sweeps):
        for d, goal in enumerate(scaled):
            have = marginal(weight, d, len(goal))
            weight = {c: w * goal[c[d]] / have[c[d]] if have[c[d]] > 0 else 0.0 for c, w in weight.items()}
        off = max((abs(h - g) for d, goal in enumerate(scaled) for h, g in zip(marginal(weight, d, len(goal)), goal, strict=True)), default=0.0)
        if off <= close or off >= before:
            break
        before = off
    total = sum(weight.values())
    return {c: w / total if total > 0 else 0.0 for c, w in weight.items()}, scaled


def marginal(weight: dict[tuple[int, int, int], float], d: int, size: int) -> list[float]:
    out = [0.0] * size
    for c, w in weight.items():
        out[c[d]] += w
    return out


def cell_table(cells: dict[tuple[int, int, int], float], goals: list[list[float]], budget_share: float) -> list[tuple]:
    """Rows (c0, c1, c2, weight, prob, and for each dimension the reached less the target share of the cell's category).

    prob: scale * weight / share, with the largest scale up to ``budget_share`` at which no probability exceeds 1; so the
    expected tokens are scale times all tokens. A cell without tokens has probability 1.
    """
    weight, goals = rake(cells, goals)
    total = sum(cells.values())
    scale = min([budget_share, *(cells[c] / total / w for c, w in weight.items() if w > 0)])
    off = [[h - g for h, g in zip(marginal(weight, d, len(goal)), goal, strict=True)] for d, goal in enumerate(goals)]
    return [(*c, weight.get(c, 0.0), min(1.0, scale * weight[c] * total / t) if t > 0 else 1.0, *(off[d][c[d]] for d in range(3))) for c, t in sorted(cells.items())]


OUT = ("weight", "prob", *(f"{d}_residual" for d in DIMS))


def _probabilities(rows: DataFrame, goals: list[list[float]], budget_share: float) -> DataFrame:
    # as many rows as the targets have combinations, at most
    sums = rows.groupBy(*CELL).agg(F.sum("n_tokens").alias("tokens")).collect()
    table = cell_table({(r[0], r[1], r[2]): float(r[3]) for r in sums}, goals, budget_share)
    return inline(rows.sparkSession, table, ", ".join((*CELL, *OUT)))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, budget_share: float = 0.9, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", topic_col: str | None = None) -> DataFrame:
    """Samples documents so that expected tokens meet target shares of source, language and topic.

    Returns doc_id, source, lang, topic, n_tokens long (words), weight (raked share of the document's cell), prob,
    sampled, and source_residual, lang_residual, topic_residual: the reached (expected) less the target share of the
    document's category. ``targets``: for each of the three, category: share; ``*`` takes all others (0 if not given);
    shares are scaled to the categories that have tokens. Without ``topic_col`` the topic is the shape of the text.
    ``budget_share``: most tokens to keep, as a share. Less are kept where targets ask for more of a cell than there is:
    the shares are met, not the budget. Targets that contradict each other leave residuals other than 0.

    Defined results: null categories belong to ``*``; a null text has no tokens, and a cell without tokens is kept; a
    row that repeats an id is decided like the first; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), *([F.col(topic_col).alias("topic")] if topic_col else []))
    rows, goals = _with_cells(rows, targets or TARGETS)
    rows = saved(rows.select("doc_id", *DIMS, "n_tokens", *CELL), "mix")
    out = rows.join(_probabilities(rows, goals, budget_share), CELL).withColumn("sampled", _draw(F.col("doc_id"), seed) < F.col("prob"))
    return out.select("doc_id", *DIMS, "n_tokens", "weight", "prob", "sampled", *OUT[2:])


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, budget_share: float = 0.9, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source and any others) that ``mix`` samples, decided alike, with their
    columns. Texts are read twice but don't move: cells are summed first, and the bounded table of cells is broadcast."""
    kept = [F.col(f"__row.{c}") for c in docs.columns]
    rows = docs.select("doc_id", "source", "lang", "text", F.struct(*docs.columns).alias("__row"))
    rows, goals = _with_cells(rows, targets or TARGETS)
    probs = _probabilities(rows, goals, budget_share)
    return rows.join(probs, CELL).where(_draw(F.col("doc_id"), seed) < F.col("prob")).select(*kept)


def mixing_report(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """What ``mix`` reached: (dimension, category, target as given, expected share, sampled share) of the tokens."""
    spec = targets or TARGETS
    class_ = lambda d: F.when(F.col(d).isin([k for k in spec[d] if k != REST]), F.col(d)).otherwise(REST)
    each = mixed.select("n_tokens", "prob", "sampled", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), class_(d).alias("category")) for d in DIMS))).alias("c"))
    sums = each.groupBy("c.dimension", "c.category").agg(F.sum(F.col("n_tokens") * F.col("prob")).alias("e"), F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("s"))
    whole = Window.partitionBy("dimension")  # a row for each category with a target
    goal = reduce(lambda out, x: F.when((F.col("dimension") == x[0]) & (F.col("category") == x[1]), F.lit(x[2])).otherwise(out), [(d, c, float(g)) for d in DIMS for c, g in spec[d].items()], F.lit(0.0))
    share = lambda c: F.when(F.sum(c).over(whole) > 0, F.col(c) / F.sum(c).over(whole)).otherwise(0.0)
    return sums.select("dimension", "category", goal.alias("target"), share("e").alias("expected"), share("s").alias("sampled"))


def _with_cells(rows: DataFrame, spec: dict[str, dict[str, float]]) -> tuple[DataFrame, list[list[float]]]:
    names = {d: [*(k for k in spec[d] if k != REST), REST] for d in DIMS}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.withColumns({"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "n_tokens": word_count(text)})
    rows = rows.withColumn("topic", F.col("topic").cast("string") if "topic" in rows.columns else shape_topic(text, F.col("n_tokens")))
    rows = rows.withColumns({c: _class_of(F.col(d), names[d]) for c, d in zip(CELL, DIMS, strict=True)})
    return rows, [[float(spec[d].get(n, 0.0)) for n in names[d]] for d in DIMS]


def _draw(id_: Column, seed: int) -> Column:
    """A number in [0, 1) by the id alone."""
    return F.shiftrightunsigned(F.xxhash64(id_, F.lit(seed)), 11) / F.lit(float(1 << 53))
