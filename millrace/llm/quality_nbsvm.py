"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their counts in the two classes, and a linear hinge-loss model is
fitted on them by dual coordinate descent. N-grams are of words (1) and of word shapes (1 to 3): letters, capitals,
digits and marks in runs, with a sign for a word that repeats its predecessor. Shares of shapes and of repeated lines
enter as indicators of tenths.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import small_batches
from .labelled import labelled_sample, scored

_CLASS = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))


def shapes(text: bytes) -> list[bytes]:
    """The shape of every word: runs of one class of bytes as one sign, '=' behind a word equal to the one before."""
    words = text.split()
    if not words:
        return []
    signs = np.frombuffer(text.translate(_CLASS), np.uint8)
    kept = signs[np.r_[True, signs[1:] != signs[:-1]]].tobytes().split()
    return [s + b"=" if same else s for s, same in zip(kept, [False, *map(eq, words[1:], words[:-1])], strict=True)]


def ngrams(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's indicators."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, indicators(text)), np.uint64))


def indicators(text: str | None) -> set[bytes]:
    """The indicators of a text, by name."""
    raw = text.encode() if text else b""
    s = shapes(raw)
    out = {b"n%d" % min(12, len(s).bit_length())}
    if s:
        out.update(b"1" + x for x in s)
        out.update(b"2" + a + b" " + b for a, b in zip(s, s[1:], strict=False))
        out.update(b"3" + a + b" " + b + b" " + c for a, b, c in zip(s, s[1:], s[2:], strict=False))
        out.update(b"%%%d" % (10 * n // len(s)) + x for x, n in Counter(s).items() if 10 * n >= len(s))
        same = sum(x.endswith(b"=") for x in s)
        out.add(b"=%d" % (10 * same // len(s)))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out.add(b"l%d" % (10 * (len(lines) - len(set(lines))) // max(1, len(lines))))
        out.update(b"w" + w for w in raw.lower().split())
    return out


def fit_hinge(index: list[np.ndarray], parts: list[np.ndarray], y: np.ndarray, box: np.ndarray, size: int, epochs: int, seed: int) -> np.ndarray:
    """Weights of a linear hinge-loss model by dual coordinate descent (Hsieh et al., 2008).

    ``index``, ``parts``: features of each example and their values, ``y``: -1 or 1, ``box``: largest dual variable of
    each example, ``size``: number of features. Stops early when no variable moves by more than 1e-3 of its range.
    """
    w, alpha = np.zeros(size), np.zeros(len(index))
    scale = [max(1e-12, float(v @ v)) for v in parts]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(index)).tolist():
            r, v = index[i], parts[i]
            gradient = y[i] * float(w[r] @ v) - 1
            new = min(max(alpha[i] - gradient / scale[i], 0.0), box[i])
            if step := new - alpha[i]:
                w[r] += step * y[i] * v
                alpha[i] = new
                moved = max(moved, abs(step) / box[i])
        if moved < 1e-3:
            break
    return w


def fit_sigmoid(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of a logistic map from margins to probabilities, by Newton steps; slope at least 0.05."""
    a, b = 1.0, 0.0
    t = np.where(label > 0, 0.995, 0.005)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, [(g * margin).sum(), g.sum()])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.05), b


class QualityModel:
    """Weights by n-gram hash (sorted), and the map from margin to probability."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.grams, self.weights, self.bias, self.slope, self.offset = grams, weights, bias, slope, offset

    def margin(self, grams: np.ndarray) -> float:
        at = np.searchsorted(self.grams, grams)
        at = at[at < len(self.grams)] if len(self.grams) == 0 else np.minimum(at, len(self.grams) - 1)
        found = at[self.grams[at] == grams] if len(at) else at
        return self.bias + float(self.weights[found].sum()) / max(1, len(found)) ** 0.5

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ngrams(text)) + self.offset, -30, 30))))


def train(grams: list[np.ndarray], label: np.ndarray, weight: np.ndarray, *, least_df: int = 3, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> QualityModel:
    """Fits the model to the n-grams (sorted hashes) of labelled rows. A fifth of them, kept from the fit, calibrates
    the scores. ``weight``: how many labelled rows a row stands for."""
    none = np.empty(0, np.uint64), np.empty(0)
    if not len(grams) or label.min() == label.max():
        prior = float(np.average(label, weights=weight)) if len(grams) else 0.5
        return QualityModel(*none, 0.0, 0.05, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))))
    rng = np.random.default_rng(seed)
    test = rng.permutation(len(grams)) % 5 == 0
    if len(set(label[~test])) < 2 or len(set(label[test])) < 2:
        test = np.zeros(len(grams), bool)
    fit = np.flatnonzero(~test)
    known, df = np.unique(np.concatenate([grams[i] for i in fit]), return_counts=True)
    known = known[df >= least_df]
    rows = [np.searchsorted(known, g[np.isin(g, known, assume_unique=True)]) for g in (grams[i] for i in fit)]
    counts = np.full((2, len(known)), smoothing)
    for i, r in zip(fit, rows, strict=True):
        counts[label[i], r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # rows are scaled to their number of n-grams, as margins are; the last feature is the constant
    index = [np.r_[r, len(ratio)] for r in rows]
    parts = [np.r_[ratio[r] / max(1, len(r)) ** 0.5, 1.0] for r in rows]
    n = np.bincount(label[fit], minlength=2)
    w = fit_hinge(index, parts, np.where(label[fit] > 0, 1.0, -1.0), cost * len(fit) / (2 * n[label[fit]]), len(ratio) + 1, epochs, seed)
    model = QualityModel(known, w[:-1] * ratio, float(w[-1]), 1.0, 0.0)
    use = np.flatnonzero(test) if test.any() else fit
    margin = np.array([model.margin(grams[i]) for i in use])
    model.slope, model.offset = fit_sigmoid(margin, label[use], weight[use] / weight[use].mean())
    return model


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams = [ngrams(t).tobytes() for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(grams, pa.binary())], ["doc_id", "label", "weight", "grams"])


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", **options) -> QualityModel:
    """Learns from at most ``per_class`` labelled rows of each class, none of them held out. ``options``: see ``train``.

    Without labelled rows every score is 0.5, with labels of one class only about their share.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, per_class, id_col=id_col, text_col=text_col).select("doc_id", "label", "weight", "text")
    sample = sample.mapInArrow(_sample_grams, "doc_id long, label int, weight double, grams binary")
    # at most 2 * per_class rows, 8 bytes an n-gram
    rows = sorted((r["doc_id"], r["label"], bytes(r["grams"]), r["weight"]) for r in sample.toLocalIterator())
    label_, weight = np.array([r[1] for r in rows], np.int64), np.array([r[3] for r in rows], np.float64)
    return train([np.frombuffer(r[2], np.uint64) for r in rows], label_, weight, **options)


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """Adds score double (0 to 1: probability of label 1) and predicted int (score >= threshold) to the carried columns.

    Defined results: a null text scores as an empty one, by the indicator of its length; repeated rows score alike; an
    empty table gives an empty result; columns named like the new ones are replaced.
    """

    def run(texts: list) -> list[pa.Array]:
        score = np.array([model.score(t) for t in texts])
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return scored(docs, run, [("score", "double"), ("predicted", "int")], text_col, carry)
