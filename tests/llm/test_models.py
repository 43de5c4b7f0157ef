from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from millrace.llm import quality_nbsvm as nb
from millrace.llm import toxicity as tx
from millrace.llm.labelled import Isotonic, held_out, labelled_sample
from millrace.llm.queries import queries

from llm_helpers import DOCS, SF, sentence

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        toxic, bad = i % 5 == 0, i % 7 == 0
        words = sentence(rng, 60).split()
        if toxic:
            for w in rng.sample(["grumble", "grumbling", "snark", "snarky"], 2):
                words[rng.randrange(len(words))] = w
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(1, None, None), (None, 1, 1), (9999, 1, 1), (2, 1, 0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_sample_keeps_held_out_rows_back(spark, corpus):
    docs, labels = corpus
    rows = labelled_sample(docs, labels, "toxic", 20).collect()
    # an id of a label without a document takes a place, too
    assert sum(r["label"] == 1 for r in rows) in (19, 20) and sum(r["label"] == 0 for r in rows) == 20
    out = {r["doc_id"] for r in docs.where(held_out()).collect()}
    assert not out & {r["doc_id"] for r in rows} and 40 < len(out) < 120
    assert sum(r["weight"] for r in rows) == pytest.approx(400 - len(out), rel=0.1)


def test_labels_without_a_document_take_no_place(spark, corpus):
    docs, labels = corpus
    strange = spark.range(10_000, 14_000).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS INT) AS toxic")
    rows = labelled_sample(docs, labels.unionByName(strange), "toxic", 20).collect()
    assert [sum(r["label"] == y for r in rows) for y in (0, 1)] == [20, 20]
    assert sum(r["weight"] for r in rows) < 400


def plain_vector(text, number, scale):
    """TF-IDF by the plain rule: {term: weight} at length 1."""
    words = Counter(w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if w in number)
    raw = {w: (1 + math.log(n)) * scale[number[w]] for w, n in words.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {w: x / norm for w, x in raw.items()}


def plain_nearest(q, examples, k):
    """Every example against the query: (similarity, position), the k nearest and all as near as the k-th."""
    found = sorted((-round(s, 12), j) for j, v in examples if (s := sum(x * v.get(w, 0.0) for w, x in q.items())) > 0)
    return [(-s, j) for s, j in found if s <= found[min(k, len(found)) - 1][0]]


@pytest.mark.parametrize("n", [1, 20, 700])
def test_top_neighbours_are_exact(n):
    rng = np.random.default_rng(2)

    def vector():
        t = np.sort(rng.choice(60, rng.integers(1, 9), replace=False, p=np.arange(1, 61) / 1830)).astype(np.int32)
        w = rng.random(len(t))
        return t, w / np.linalg.norm(w)

    examples = [vector() for _ in range(n)]
    index = tx.BlockMaxIndex(examples, 60)
    plain = [dict(zip(t.tolist(), w.tolist(), strict=True)) for t, w in examples]
    for k in (1, 7, 900):
        queries_, without = [vector() if i % 2 else examples[i % n] for i in range(60)], [np.array([i % n, (i + 1) % n]) for i in range(60)]
        for held in (None, without):
            for i, (s, at) in enumerate(index.top(queries_, k, held)):
                left = [(j, v) for j, v in enumerate(plain) if held is None or j not in held[i]]
                want = plain_nearest(dict(zip(*(x.tolist() for x in queries_[i]), strict=True)), left, k)
                assert s.tolist() == pytest.approx([x for x, _ in want], abs=1e-11)
                assert k == 7 or set(at.tolist()) == {j for _, j in want}
    none = np.empty(0, np.int32), np.empty(0)
    assert len(index.top([none], 3)[0][0]) == 0 and len(tx.BlockMaxIndex([], 4).top([(np.array([1]), np.ones(1))], 3)[0][0]) == 0


def test_neighbours_are_those_of_plain_cosine(spark):
    """Every document of the table against every example, term by term."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = tx.fit_toxicity(docs, labels)
    sample = {r["doc_id"]: r["label"] for r in labelled_sample(docs, labels, "toxic", 3000).collect()}
    assert set(model.ids.tolist()) <= set(sample) and all(sample[i] == y for i, y in zip(model.ids.tolist(), model.labels.tolist(), strict=True))
    words = {w for i in sample for w in re.findall(r"[^\W\d_]+", (texts[i] or "").lower())}
    assert len(words) == len(model.hashes)  # every word of every example, whatever its label
    number = {w: int(np.searchsorted(model.hashes, np.uint64(xxhash.xxh64_intdigest(w)))) for w in words}
    df = Counter(w for t in texts.values() for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())) & words)
    n = len(texts)
    assert all(model.scale[number[w]] >= math.log((n + 1) / (df[w] + 1)) + 1 - 1e-9 for w in words)
    examples = [(j, plain_vector(texts[i], number, model.scale)) for j, i in enumerate(model.ids.tolist())]
    rows = {r["doc_id"]: r for r in tx.score_toxicity(docs, model).collect()}
    for i, text in texts.items():
        want = plain_nearest(plain_vector(text, number, model.scale), examples, model.k)
        vote = sum(s * s * model.labels[j] for s, j in want) / sum(s * s for s, _ in want) if want else -1.0
        score = float(model.calibrate(np.array([vote]))[0]) if want else model.lone
        assert rows[i]["score"] == pytest.approx(min(1.0, max(0.0, score)), abs=1e-6)
        assert [e["similarity"] for e in rows[i]["evidence"]] == pytest.approx([s for s, _ in want[:3]], abs=1e-9)
        assert bool(want) == bool(set(re.findall(r"[^\W\d_]+", (text or "").lower())) & words)


def test_toxicity(spark, corpus):
    docs, labels = corpus
    model = tx.fit_toxicity(docs, labels, per_class=500)
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id < 400 AND toxic IS NOT NULL").collect()}
    rows = tx.score_toxicity(docs, model).collect()
    tested = [r for r in rows if r["doc_id"] in {x["doc_id"] for x in docs.where(held_out()).collect()}]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in rows)
    hit = next(r for r in rows if r["predicted"] == 1)
    assert hit["evidence"][0]["label"] == 1 and hit["evidence"][0]["similarity"] > 0
    assert set(rows[0].asDict()) == {*DOCS.replace(" long", "").replace(" string", "").split(", "), "score", "predicted", "evidence"}


def test_toxic_words_too_varied_to_be_chosen(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(480):
        toxic = i % 4 == 0
        words = sentence(rng, 40).split()
        if toxic:  # 40 groups of three that share no toxic word with another
            group = random.Random(i // 12)
            words[:12] = ["".join(group.choices("abcdefghijklmnopqrstuvxyz", k=8)) for _ in range(12)]
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = tx.fit_toxicity(docs, labels)
    out = {r["doc_id"] for r in docs.where(held_out()).collect()}
    rows = [r for r in tx.score_toxicity(docs, model).collect() if r["doc_id"] in out]
    assert all(len(r["evidence"]) == 3 and r["evidence"][0]["similarity"] > 0 for r in rows)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows) >= 0.9 * len(rows)


def test_all_examples_as_near_as_the_last_vote():
    # 40 clean and 60 toxic examples with the same only term; 100 clean ones with another
    hashes = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in ("bad", "good")], np.uint64))
    own = {w: tx.known(hashes, *tx.features(w)) for w in ("bad", "good")}
    examples = [(i, int(40 <= i < 100), 1.0, *own["good" if i >= 100 else "bad"]) for i in range(200)]
    model = tx.ToxicityModel(hashes, np.ones(2), examples, np.arange(200), 15)
    s, at = model.index.top([model.vector(*own["bad"])], 15)[0]
    assert sorted(model.ids[at].tolist()) == list(range(100)) and model.vote(s, at) == pytest.approx(0.6)
    score, near = model.judge(["bad", "good"])
    assert score[0] == pytest.approx(0.6, abs=0.05) and score[1] < 0.05 and len(near[0][0]) == 3


def test_unlike_texts_of_one_id_are_examples_each(spark):
    docs = spark.createDataFrame([(2, "alpha beta", "en", "s", 1), (2, "gamma delta", "en", "s", 1), (3, "gamma delta", "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(2, 1, 1), (3, 1, 0)], LABELS)
    model = tx.fit_toxicity(docs, labels)
    assert sorted(zip(model.ids.tolist(), model.labels.tolist(), strict=True)) == [(2, 1), (2, 1), (3, 0)]


def test_toxicity_odd_rows(spark, corpus, odd_docs, no_docs):
    docs, labels = corpus
    model = tx.fit_toxicity(docs, labels)
    rows = tx.score_toxicity(odd_docs, model).collect()
    assert len(rows) == 11 and all(r["score"] == model.lone for r in rows if not (r["text"] or "").strip())
    assert tx.score_toxicity(no_docs, model).collect() == []
    for table in (labels.where("false"), labels.where("toxic = 1")):
        assert all(r["predicted"] in (0, 1) for r in tx.score_toxicity(docs.limit(5), tx.fit_toxicity(docs, table)).collect())
    assert tx.score_toxicity(docs.limit(2), tx.fit_toxicity(no_docs, labels)).count() == 2


def test_near_copies_are_one_family():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    copy = base.copy()
    copy[:6] = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    other = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    f = tx.near_copies([base, copy, other, np.empty(0, np.uint64)])
    assert f[0] == f[1] and len({f[0], f[2], f[3]}) == 3
    terms, counts, n0, n1 = tx.count_families([base, copy, other], np.array([1, 1, 0]), f[:3])
    assert (n0, n1) == (1, 1) and counts[np.isin(terms, base)].max() == 1


def test_isotonic():
    c = Isotonic(np.array([0.1, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 1]), np.ones(4))
    assert list(c(np.array([0.0, 0.25, 1.0]))) == sorted(c(np.array([0.0, 0.25, 1.0]))) and 0 <= c(np.array([0.1]))[0] <= 1


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    y = np.where(x @ np.array([1.0, -2, 0.5, 0, 0]) + 0.3 * rng.normal(size=120) > 0, 1.0, -1.0)
    index, parts = [np.arange(5)] * 120, list(x)
    w = nb.fit_hinge(index, parts, y, np.full(120, 0.5), 5, 3000, 1)
    loss = lambda v: 0.5 * v @ v + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()
    best = min(loss(w + d) for d in rng.normal(size=(3000, 5)) * rng.choice([1e-3, 1e-2, 0.1], (3000, 1)))
    assert loss(w) <= best + 1e-3


def test_shapes():
    assert nb.shapes(b"The The cat** 12 x") == [b"Aa", b"Aa=", b"a*", b"0", b"a"]
    assert nb.shapes(b"  ") == [] and len(nb.ngrams(None)) == 1 == len(nb.ngrams(""))


def test_quality(spark, corpus):
    docs, labels = corpus
    model = nb.fit_quality(docs, labels, per_class=500)
    truth = {r["doc_id"]: r["quality"] for r in labels.where("doc_id < 400 AND quality IS NOT NULL").collect()}
    out = {x["doc_id"] for x in docs.where(held_out()).collect()}
    rows = [r for r in nb.score_quality(docs, model).collect() if r["doc_id"] in out]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_all_ngrams_of_three_rows_are_kept():
    grams = np.arange(150_000, dtype=np.uint64)
    label = np.array([0, 1] * 10)
    model = nb.train([grams if y else grams[:100_000] for y in label], label, np.ones(20), epochs=1)
    assert len(model.grams) == 150_000


def test_quality_odd_rows(spark, corpus, odd_docs, no_docs):
    docs, labels = corpus
    model = nb.fit_quality(docs, labels)
    rows = nb.score_quality(odd_docs, model).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert nb.score_quality(no_docs, model).collect() == []
    for table in (labels.where("false"), labels.where("quality = 1"), labels.limit(3)):
        assert nb.score_quality(docs.limit(3), nb.fit_quality(docs, table)).count() == 3


def ranked(score, label):
    """The area under the ROC curve by all pairs."""
    bad, good = (np.array([s for s, y in zip(score, label, strict=True) if y == c]) for c in (0, 1))
    return float(((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()))


@pytest.mark.parametrize(("name", "label", "rare", "auc", "recall", "precision"), [("op2_toxicity", "toxic", 1, 0.95, 0.85, 0.9), ("op3_quality_classifier", "quality", 0, 0.98, 0.9, 0.9)])
def test_queries_on_held_out_rows(spark, name, label, rare, auc, recall, precision):
    """A constant score has an area of 0.5 and finds no row of the rare class."""
    sf = "/root/testdata/sf0.1"
    rows = queries()[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    tested = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    score, predicted, true = zip(*tested, strict=True)
    assert ranked(score, true) >= auc
    hits = sum(p == rare == y for p, y in zip(predicted, true, strict=True))
    assert hits >= recall * true.count(rare) and hits >= precision * predicted.count(rare)
    assert spark.read.parquet(f"{SF}/documents.parquet").count() == queries()[name](spark, SF).count()
