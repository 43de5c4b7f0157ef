from __future__ import annotations

import numpy as np
import pytest

from millrace.llm import embedding_dedup as ed
from millrace.llm.queries import queries


def brute(ids, vectors, cosine=0.95):
    """Links and components by all pairs, in double precision."""
    x = np.array([np.asarray(v, np.float64) / np.linalg.norm(v) for v in vectors])
    near = x @ x.T >= cosine
    links = near.sum(1) - 1
    comp = np.array(ids)
    while True:
        low = np.array([comp[near[i]].min() for i in range(len(ids))])
        if (low == comp).all():
            return dict(zip(ids, links.tolist(), strict=True)), dict(zip(ids, comp.tolist(), strict=True))
        comp = low


def made(seed, dims=24, n=300):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dims) for _ in range(n)]
    for size, noise in ((60, 0.05), (30, 0.2), (10, 0.25), (5, 0.0)):
        c = rng.normal(size=dims)
        rows += [c + noise * rng.normal(size=dims) for _ in range(size)]
    rows += [3.5 * rows[0], -1 * rows[1]]
    order = rng.permutation(len(rows))
    return [[float(x) for x in rows[i]] for i in order]


@pytest.mark.parametrize("block", [16, 2048])
def test_every_link_with_full_slack(spark, block):
    rows = made(1)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(5)
    got = ed.near_duplicate_vectors(df, slack=1.0, probes=None, block=block, subspaces=6).collect()
    links, comp = brute(list(range(len(rows))), rows)
    assert {r["vec_id"]: r["n_links"] for r in got} == links
    assert {r["vec_id"]: r["component_id"] for r in got} == comp
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_of_the_default(spark):
    rows = made(2)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in ed.near_duplicate_vectors(df).collect()}
    links, _ = brute(list(range(len(rows))), rows)
    assert sum(got.values()) >= 0.9 * sum(links.values()) and all(got[i] <= links[i] for i in got)


def test_both_ends_count_a_link_across_lists(spark):
    # points along an arc: differences lie across the planes between lists
    rows = [[float(np.cos(a)), float(np.sin(a))] for a in np.linspace(0, 3, 400)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in ed.near_duplicate_vectors(df, lists=12).collect()}
    assert got == brute(list(range(len(rows))), rows)[0]


def test_repeated_ids_are_judged_by_their_own_vector(spark):
    rows = [(9, [1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.01, 1.0, 0.0]), (5, [0.0, 0.0, 1.0]), (5, [0.0, 0.02, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in ed.near_duplicate_vectors(df).collect())
    assert got == [(2, 1, 2, True), (3, 1, 3, True), (5, 1, 5, True), (5, 1, 5, True), (9, 1, 2, False), (9, 1, 3, False)]


def test_every_dimension_has_its_links(spark):
    rng = np.random.default_rng(3)
    rows = []
    for dims, n in ((3, 30), (8, 12), (1, 4)):
        x = [rng.normal(size=dims) for _ in range(n)]
        rows += [[float(v) for v in r] for r in [*x, *(2 * r for r in x[: n // 2])]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_duplicate_vectors(df, probes=None).collect()}
    for dims in (3, 8, 1):
        ids = [i for i, r in enumerate(rows) if len(r) == dims]
        links, comp = brute(ids, [rows[i] for i in ids])
        assert {i: got[i] for i in ids} == {i: (links[i], comp[i]) for i in ids}


def test_work_of_a_vector_does_not_grow_with_the_lists():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for lists in (5, 60, 240):
        own, asks = ed.ProductIndex(x, lists, 8, 0.95, 0.5, 1, 8).asked(x)
        assert asks.sum(1).max() <= 8 and asks[np.arange(len(x)), own].all()
        everything = ed.ProductIndex(x, lists, 8, 0.95, 0.5, 1).asked(x)[1]
        assert (everything >= asks).all() and (lists > 5) == bool((everything > asks).any())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [1e200, 2e200]), (11, [1e-200, 2e-200])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, key string, n_links string")
    got = ed.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] in (0, 1, 9, 10, 11)} == {(i, 5, 0) for i in (0, 1, 9, 10, 11)}
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in got if r["vec_id"] in (2, 3, 4, 5, 6, 7, 8, None))
    assert ed.near_duplicate_vectors(df.where("false")).collect() == []
    assert ed.near_duplicate_vectors(df.where("vec_id = 2")).first()["kept"]


def test_table_distances_bound_the_true_ones():
    rng = np.random.default_rng(6)
    x = np.array([ed.unit_vector(v.tolist()) for v in rng.normal(size=(500, 20))])
    index = ed.ProductIndex(x, 12, 5, 0.95, 1.0, 1)
    own, codes, error, asks = index.place(x)
    m = np.flatnonzero(own == own[0])
    coded = np.sqrt(index.table_distances(x, int(own[0]), codes[m]))
    true = np.sqrt(ed.squares(x, x[m]))
    assert (np.abs(coded - true) <= error[m] + 1e-9).all()
    near = ed.squares(x, x) <= index.radius**2
    assert all(own[j] in asks[i] for i, j in zip(*np.nonzero(near), strict=True))


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_query(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    links, comp = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    got = queries()["op4_embedding_dedup"](spark, sf).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == links and {r["vec_id"]: r["component_id"] for r in got} == comp
