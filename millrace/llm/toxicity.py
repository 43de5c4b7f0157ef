"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The terms are all words of a bounded labelled sample, of both classes; none is dropped. A term weighs (1 + ln tf) * idf
* (1 + relevance * G2): inverse document frequencies count all documents, and G2, the likelihood ratio of the term's
counts in the two classes, lets words that tell the classes apart count for more than chance ones. The examples form an
inverted index cut into blocks of consecutive examples; each posting list keeps its largest weight per block, so a query
scores the blocks of the highest bounds first and then only those whose bound reaches its k-th neighbour: the result is
exact. Votes weighted by similarity are calibrated on the examples, each held against the others without its near copies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import Isotonic, labelled_sample, scored

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64
#: Queries that are compared at once.
BATCH = 128
#: Terms whose document counts travel in one row.
PART = 8192
EVIDENCE = 3
_PLACES = 12


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the distinct words of a text, their counts)."""
    words = Counter(WORD.findall(text.lower())) if text else {}
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    counts = np.fromiter(words.values(), np.int32, len(words))
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def near_copies(examples: list[np.ndarray], bands: int = 8, rows: int = 8, least: float = 0.6, seed: int = 3) -> np.ndarray:
    """A family number for each example (hashes of its terms): near copies share one. They meet in a band of minimal
    hashes and agree in at least ``least`` of all. Copies of a text say no more about its words than the text alone,
    so terms are counted by family."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    parent = list(range(len(examples)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    marks = np.zeros((len(examples), bands * rows), np.uint64)
    first: dict[tuple, int] = {}
    for i, h in enumerate(examples):
        if len(h):
            marks[i] = ((h[:, None] * a + b) >> np.uint64(16)).min(0)
            for band, key in enumerate(map(bytes, marks[i].reshape(bands, rows))):
                j = first.setdefault((band, key), i)
                if j != i and (marks[i] == marks[j]).mean() >= least and find(i) != find(j):
                    parent[find(i)] = find(j)
    return np.array([find(i) for i in range(len(examples))], np.int64)


def count_families(examples: list[np.ndarray], labels: np.ndarray, families: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(term hashes, their families in class 0 and 1 as two columns, families of class 0, of class 1)."""
    sizes, found = [], []
    for y in (0, 1):
        groups: dict[int, list[np.ndarray]] = {}
        for i in np.flatnonzero(labels == y).tolist():
            groups.setdefault(int(families[i]), []).append(examples[i])
        sizes.append(len(groups))
        parts = [np.unique(np.concatenate(g)) for g in groups.values()]
        found.append(np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64)))
    terms = np.union1d(found[0][0], found[1][0])
    counts = np.zeros((len(terms), 2), np.int64)
    for y in (0, 1):
        counts[np.searchsorted(terms, found[y][0]), y] = found[y][1]
    return terms, counts, sizes[0], sizes[1]


def likelihood_ratio(counts: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """The likelihood ratio of terms against chance, from their families in both classes; 0 if a class has none."""
    g2 = np.zeros(len(counts))
    if not n0 or not n1:
        return g2
    total, seen = n0 + n1, counts.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for y, n in ((0, n0), (1, n1)):
            for o, e in ((counts[:, y], seen * n / total), (n - counts[:, y], (total - seen) * n / total)):
                g2 += np.where(o > 0, 2 * o * np.log(o / e), 0.0)
    return np.maximum(g2, 0.0)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of several runs, one run after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class BlockMaxIndex:
    """Exact top-k by dot product over sparse vectors of positive weights, in blocks of consecutive examples.

    Terms of few examples are posting lists. Terms of an eighth of the examples or more (at most eight times the mean
    number of terms of an example) are kept as full rows, cut into the blocks, with the largest weight in each block.
    A query adds up its short lists; with these sums and the block maxima of its other terms every block has a bound.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.n = len(vectors)
        self.blocks = max(1, -(-self.n // BLOCK))
        numbers = np.concatenate([t for t, _ in vectors]).astype(np.int64) if vectors else np.empty(0, np.int64)
        weights = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        ids = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        often = np.flatnonzero(np.bincount(numbers, minlength=terms) * 8 >= max(8, self.n))
        self.row = np.full(terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        row = self.row[numbers]
        self.rows = np.zeros((self.blocks, len(often), BLOCK))
        in_ = row >= 0
        self.rows[ids[in_] // BLOCK, row[in_], ids[in_] % BLOCK] = weights[in_]
        self.bounds = self.rows.max(2).T.copy()
        order = np.argsort(numbers[~in_], kind="stable")
        self.ids, self.weights = ids[~in_][order].astype(np.int32), weights[~in_][order]
        self.starts = np.searchsorted(numbers[~in_][order], np.arange(terms + 1)).astype(np.int32)

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (numbers, weights) the (similarities, positions) of the ``k`` examples of largest positive
        similarity and of all others as similar as the k-th, most similar first, ties by position. ``without``:
        positions to leave out."""
        size = self.blocks * BLOCK
        part, q = np.zeros((len(queries), size)), np.zeros((len(queries), self.rows.shape[1]))
        for j, (numbers, weights) in enumerate(queries):
            row = self.row[numbers]
            often = row >= 0
            q[j, row[often]] = weights[often]
            starts = self.starts[numbers[~often]]
            count = self.starts[numbers[~often] + 1] - starts
            at = spans(starts, count)
            part[j] = np.bincount(self.ids[at], self.weights[at] * np.repeat(weights[~often], count), size)
            if without is not None:
                part[j, without[j]] = -np.inf
        bound = part.reshape(len(queries), self.blocks, BLOCK).max(2) + q @ self.bounds
        total = np.full(part.shape, -np.inf)

        def score(open_: np.ndarray) -> np.ndarray:
            """The k-th best score so far, after some blocks were opened for some queries."""
            for b in np.flatnonzero(open_.any(0)).tolist():
                who, at = np.flatnonzero(open_[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                total[who, at] = part[who, at] + q[who] @ self.rows[b]
            return np.partition(total, size - k, axis=1)[:, size - k] if size > k else np.zeros(len(queries))

        opened = np.zeros(bound.shape, bool)
        first = min(self.blocks, 1 + -(-k // BLOCK))
        np.put_along_axis(opened, np.argsort(-bound, axis=1, kind="stable")[:, :first], True, 1)
        least = score(opened)
        # no other block can hold a nearer one than the k-th so far
        least = score(~opened & (bound > 0) & (bound >= least[:, None] - 1e-9))
        out = []
        for own, limit in zip(total, np.round(least, _PLACES), strict=True):
            found = np.flatnonzero((own > 0) & (own >= limit - 1e-11))
            near = np.round(own[found], _PLACES)
            found, near = found[near >= limit], near[near >= limit]
            order = np.argsort(-near, kind="stable")
            out.append((near[order], found[order]))
        return out


class ToxicityModel:
    """The index of the examples, the weights of their terms and the calibration."""

    def __init__(self, hashes: np.ndarray, scale: np.ndarray, examples: list[tuple], families: np.ndarray, k: int):
        """``hashes``: sorted, of all terms; ``scale``: idf times relevance of each; ``examples``: (doc_id, label, weight,
        numbers of its terms, their counts); ``families``: see ``near_copies``."""
        self.hashes, self.scale, self.k = hashes, scale, k
        vectors = [self.vector(n, c) for *_, n, c in examples]
        # neighbours in blocks: by the heaviest of the most frequent terms; never by label, as ties go by position
        df = np.bincount(np.concatenate([t for t, _ in vectors]), minlength=len(hashes)) if vectors else np.empty(0)
        often = [t[w.argmax()] if len(t) and (w := w_ * (8 * df[t] >= len(vectors))).any() else -1 for t, w_ in vectors]
        order = sorted(range(len(examples)), key=lambda i: (int(often[i]), examples[i][0], i))
        examples, vectors, families = [examples[i] for i in order], [vectors[i] for i in order], families[order]
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], np.int64)
        weight = np.array([e[2] for e in examples], np.float64)
        self.index = BlockMaxIndex(vectors, len(hashes))
        members = {f: np.flatnonzero(families == f) for f in np.unique(families).tolist()}
        near = (n for a in range(0, len(vectors), BATCH) for n in self.index.top(vectors[a : a + BATCH], k, [members[f] for f in families[a : a + BATCH].tolist()]))
        raw = np.array([self.vote(*n) for n in near])
        lone = raw < 0
        self.prior = float((self.labels * weight).sum() / weight.sum()) if len(examples) else 0.0
        # without any neighbour: the rate of label 1 among such examples
        self.lone = float(((self.labels * weight)[lone].sum() + 0.5 * self.prior) / (weight[lone].sum() + 0.5)) if len(examples) else 0.0
        self.calibrate = Isotonic(raw[~lone], self.labels[~lone], weight[~lone])

    def vector(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of a text."""
        w = (1 + np.log(counts)) * self.scale[numbers]
        return numbers, w / max(1e-300, float(w @ w) ** 0.5)

    def terms(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the terms of a text, ascending, their counts)."""
        return known(self.hashes, *features(text))

    def vote(self, similarity: np.ndarray, at: np.ndarray) -> float:
        """The share of label 1 among neighbours, weighted by the squared similarity; -1 without any."""
        own = similarity * similarity
        return float((own * self.labels[at]).sum() / own.sum()) if len(at) else -1.0

    def judge(self, texts: list) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Scores of texts, and the (similarities, positions) of their nearest examples."""
        near = [n for a in range(0, len(texts), BATCH) for n in self.index.top([self.vector(*self.terms(t)) for t in texts[a : a + BATCH]], self.k)]
        raw = np.array([self.vote(*n) for n in near])
        score = np.where(raw < 0, self.lone, self.calibrate(raw))
        return np.clip(score, 0.0, 1.0), [(s[:EVIDENCE], at[:EVIDENCE]) for s, at in near]


def known(hashes: np.ndarray, own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers among the sorted ``hashes``, counts) of those hashes of a text that are there."""
    if not len(hashes):
        return np.empty(0, np.int32), np.empty(0, np.int32)
    at = np.searchsorted(hashes, own)
    at[at == len(hashes)] = 0
    hit = hashes[at] == own
    return at[hit].astype(np.int32), counts[hit]


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1))], ["doc_id", "label", "weight", "hashes", "counts"])


def _document_counts(hashes: np.ndarray):
    """Documents, as part -1, and documents of each term, in parts of consecutive terms."""

    def run(batches):
        seen, docs = np.zeros(len(hashes), np.int64), 0
        for b in batches:
            docs += b.num_rows
            for t in b.column(0).to_pylist():
                seen[known(hashes, *features(t))[0]] += 1
        for part, counts in [(-1, np.array([docs])), *((a, seen[a : a + PART]) for a in range(0, len(seen), PART))]:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["part", "docs"])

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
    for part, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["part", "docs"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 3000, relevance: float = 0.5, k: int = 15, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns from at most ``per_class`` labelled rows of each class; document frequencies count all of ``docs``.

    ``relevance``: weight of the likelihood ratio of a term, 0 for plain TF-IDF. ``k``: neighbours. Equal texts of one
    label are one example, named by their smallest id; unlike texts under one id are examples each. Without labelled
    rows every score is 0.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, per_class, id_col=id_col, text_col=text_col).select("doc_id", "label", "weight", "text")
    # 12 bytes a distinct word of the sample's rows
    rows = sample.mapInArrow(_sample_terms, "doc_id long, label int, weight double, hashes binary, counts binary")
    merged: dict[tuple, list] = {}
    for r in rows.toLocalIterator():
        own = merged.setdefault((r["label"], bytes(r["hashes"]), bytes(r["counts"])), [r["doc_id"], 0.0])
        own[:] = min(own[0], r["doc_id"]), own[1] + r["weight"]
    found = sorted((i, y, h, c, w) for (y, h, c), (i, w) in merged.items())
    del merged
    sets, marks = [np.frombuffer(h, np.uint64) for _, _, h, _, _ in found], np.array([y for _, y, *_ in found], np.int64)
    families = near_copies(sets)
    hashes, counts, n0, n1 = count_families(sets, marks, families)
    ratio = likelihood_ratio(counts, n0, n1)
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_document_counts(hashes), "part long, docs binary").repartition("part").mapInArrow(_sum_counts, "part long, docs binary")
    parts = {r["part"]: np.frombuffer(r["docs"], np.int64) for r in counted.toLocalIterator()}  # 8 bytes a term
    n = int(parts[-1][0]) if -1 in parts else 0
    df = np.concatenate([parts[a] for a in range(0, len(hashes), PART)]) if len(hashes) else np.empty(0, np.int64)
    scale = (np.log((n + 1) / (df + 1)) + 1) * (1 + relevance * ratio)
    examples = [(i, y, w, np.searchsorted(hashes, h).astype(np.int32), np.frombuffer(c, np.int32)) for (i, y, _, c, w), h in zip(found, sets, strict=True)]
    return ToxicityModel(hashes, scale, examples, families, k)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """Adds score double (0 to 1), predicted int (score >= threshold) and evidence (the nearest examples: doc_id,
    label, similarity) to the carried columns (all by default).

    Defined results: a null or empty text, and one without any word of the examples, has no neighbours: its score is the
    rate of label 1 among such examples, its evidence empty. All examples as similar as the k-th vote, whatever their
    label; in the evidence ties go by position in the index. Repeated rows score alike; an empty table gives an empty
    result; columns named like the new ones are replaced.
    """

    def run(texts: list) -> list[pa.Array]:
        score, near = model.judge(texts)
        at = np.concatenate([p for _, p in near])
        parts = [pa.array(model.ids[at]), pa.array(model.labels[at].astype(np.int32)), pa.array(np.concatenate([s for s, _ in near]))]
        ends = np.cumsum([0, *(len(p) for _, p in near)]).astype(np.int32)
        evidence = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["doc_id", "label", "similarity"]))
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32)), evidence]

    return scored(docs, run, [("score", "double"), ("predicted", "int"), ("evidence", "array<struct<doc_id:bigint,label:int,similarity:double>>")], text_col, carry)
