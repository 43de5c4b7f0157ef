"""Each stage of the corpus pipeline against the plain rule it stands for."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as p
from millrace.llm.common import saved, scratch
from millrace.llm.mixing import mix
from millrace.llm.quality_nbsvm import fit_quality
from millrace.llm.toxicity import fit_toxicity

from llm_helpers import DOCS, sentence
from test_ngram_join import plain_components, plain_sets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def kept(df):
    return {r["doc_id"] for r in df.collect()}


def test_classifier_stages(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic, good = fit_toxicity(docs, labels), fit_quality(docs, labels)
    out = p.toxicity(spark, docs, SF)
    assert out.columns == docs.columns and kept(out) == {i for i, t in texts.items() if toxic.judge([t])[0][0] < 0.5}
    assert kept(p.quality(spark, docs, SF)) == {i for i, t in texts.items() if good.score(t) >= 0.3}


def test_near_duplicates_stage(spark):
    rng = random.Random(1)
    base = sentence(rng, 50)
    texts = [sentence(rng, 40) for _ in range(20)] + [base + f" end{i}" for i in range(6)] + ["", "", "a b", "a b"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (None, base, "en", "s", 0), (50, None, None, None, None)], DOCS)
    out = p.near_duplicates(spark, df, SF).collect()
    comp = plain_components(plain_sets(texts, 5), range(len(texts)), 80)
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == sorted([*(i for i, c in comp.items() if i == c), 50])
    assert sum(r["doc_id"] is None for r in out) == 1


def test_mixing_stage(spark, docs):
    assert kept(p.mixing(spark, docs, SF)) == {r["doc_id"] for r in mix(docs).collect() if r["sampled"]}


def test_run(spark, docs):
    rows = p.run(spark, SF).collect()
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["doc_id"] for r in rows} <= kept(docs)


def test_stages_on_empty_input(spark, docs):
    none = docs.where("false")
    for _, stage in p.STAGES:
        assert stage(spark, none, SF).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality", "near_duplicates", "mixing"])
def test_stages_on_odd_rows(spark, odd_docs, name):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns: kept rows come back as they were."""
    out = dict(p.STAGES)[name](spark, odd_docs, SF)
    assert out.columns == odd_docs.columns
    rows, before = [tuple(r) for r in out.collect()], [tuple(r) for r in odd_docs.collect()]
    assert all(r in before for r in rows)
    if name == "near_duplicates":
        # 0 and 5 share a text, 6 and 7 words but for case; 1, 2 and 3 have none
        assert sorted((r[0], r[1]) for r in rows if r[0] is not None and r[0] != 4) == sorted([(0, before[0][1]), (1, None), (2, ""), (3, " \t\n"), (5, "another text"), (6, "One  two")], key=lambda x: x[0])
    else:  # equal rows are decided alike
        assert all(rows.count(r) == before.count(r) for r in rows)


def test_packing_stage_on_odd_rows(spark, odd_docs):
    assert p.packing(spark, odd_docs, SF).count() == odd_docs.count()


def test_stages_without_labels_drop_nothing(spark, docs, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (p.toxicity, p.quality):
        assert stage(spark, docs, str(tmp_path)).count() == docs.count()


def test_near_duplicates_by_an_id_or_by_rows(spark, docs):
    """With one repeated row the stage takes the other way and keeps the same documents."""
    once = kept(p.near_duplicates(spark, docs, SF))
    assert once == kept(p.near_duplicates(spark, docs.unionByName(docs.where("doc_id = 0")), SF))
    comp = plain_components(plain_sets([r["text"] for r in docs.collect()], 5), [r["doc_id"] for r in docs.collect()], 80)
    assert once == {i for i, c in comp.items() if i == c}


def test_scratch_is_deleted(spark, tmp_path):
    import glob

    root = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{root}/millrace/*"))
    with scratch(spark):
        inner = saved(spark.range(5), "inner")
        outer = saved(inner, "outer", aside=False)
        assert inner.count() == 5
    left = set(glob.glob(f"{root}/millrace/*")) - before
    assert len(left) == 1 and "outer" in left.pop() and outer.count() == 5
