from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import ngram_join as nj
from millrace.llm.common import components
from millrace.llm.queries import queries

from llm_helpers import DOCS, SF, rows_of, sentence


def plain_sets(texts, width):
    out = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def plain_components(sets, ids, percent):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, sets, strict=True):
        for j, b in zip(ids, sets, strict=True):
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def family(rng, n_words, members, edits):
    base = sentence(rng, n_words).split()
    out = []
    for _ in range(members):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(60)]
    for n in (3, 12, 40, 90, 200):
        texts += family(rng, n, 14, max(1, n // 25))
    shared = sentence(rng, 60, "p")
    texts += [f"{shared} {sentence(rng, 10, 'q')}" for _ in range(25)]
    texts += ["Same TEXT here now", "same text\there  now", "a", "A", "", None]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "width", "percent", "rare"), [(1, 4, 85, 256), (2, 4, 85, 3), (3, 5, 80, 4), (4, 2, 60, 5)])
def test_against_brute_force(spark, seed, width, percent, rare):
    texts = corpus(seed)
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows_of(texts), DOCS).repartition(7), width=width, percent=percent, rare_df=rare, seed_rounds=2).collect()
    sets = plain_sets(texts, width)
    want = plain_components(sets, range(len(texts)), percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_rounds_do_not_change_the_result(spark, rounds):
    texts = corpus(9)
    df = spark.createDataFrame(rows_of(texts), DOCS)
    got = nj.ngram_jaccard_join(df, width=4, percent=85, rare_df=2, seed_rounds=rounds).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(plain_sets(texts, 4), range(len(texts)), 85)


def test_odd_rows(odd_docs, no_docs):
    rows = nj.ngram_jaccard_join(odd_docs).collect()
    assert len(rows) == 11
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] in (1, 2, 3)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [(r["n_shingles"] > 0, r["component_id"]) for r in rows if r["doc_id"] is None] == [(True, None)]
    assert sorted((r["component_id"], r["copy_of"]) for r in rows if r["doc_id"] == 5) == [(0, 0), (0, 0), (5, 5)]
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    assert nj.ngram_jaccard_join(no_docs).collect() == []


def test_repeated_ids_join_nothing(spark):
    """Two unlike texts of one id, each near another document: these two stay apart."""
    rng = random.Random(4)
    a, b = sentence(rng, 60), sentence(rng, 60)
    texts = [(5, a), (5, b), (3, a + " end"), (9, b + " end"), (9, b + " end"), (2, sentence(rng, 60))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS).repartition(3)
    got = sorted((r["doc_id"], r["component_id"]) for r in nj.ngram_jaccard_join(df).collect())
    assert got == [(2, 2), (3, 3), (5, 3), (5, 5), (9, 5), (9, 5)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4000), st.integers(51, 99), st.data())
def test_similar_sizes_share_a_class(n, percent, data):
    m = data.draw(st.integers(-(-percent * n // 100), n * 100 // percent))
    assert set(nj.size_classes(n, percent)) & set(nj.size_classes(m, percent))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 120), st.integers(0, 120), st.sampled_from([60, 80, 85, 95]))
def test_similar_sets_share_a_signature(seed, n, rare, percent):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64))
    a = pool[rng.permutation(len(pool))[:n]]
    drop, add = rng.integers(0, n // 5 + 1, 2)
    b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
    inter = len(np.intersect1d(a, b))
    if min(len(a), len(b)) < 2 or 100 * inter < percent * len(np.union1d(a, b)):
        return
    key = {int(t): i for i, t in enumerate(rng.permutation(np.union1d(a, b)))}  # any one order, its first tokens rare
    parts = []
    for s in (a, b):
        s = np.array(sorted(s.tolist(), key=key.get), np.uint64)
        parts.append(set(nj.set_signatures(len(s), sum(key[int(t)] < rare for t in s), s, percent).tolist()))
    assert parts[0] & parts[1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=50))
def test_packing_roundtrip(values):
    a = np.array(values, np.uint64)
    b = (a & np.uint64(0xFFFF)).astype(np.uint16)
    (x, y), end = nj.unpack(nj.pack(a, b), "u8 u2")
    assert (x == a).all() and (y == b).all() and end == len(nj.pack(a, b))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)] + [(7, None), (8, 8)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    for few in (0, 10**6):
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert got == {i: find(i) for i in list(parent)}
        assert components(spark.createDataFrame([], "a long, b long"), few=few).collect() == []


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries()["op1_ngram_jaccard_join"](spark, SF).collect()
    want = plain_components(plain_sets(texts.values(), 4), list(texts), 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
