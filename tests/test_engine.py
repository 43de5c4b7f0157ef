"""Index, boolean queries, ranking, Zipf, metrics, evaluation, ingest, streaming and command line on small corpora."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace import cli
from millrace.operators import boolean, evaluation, metrics, ranking, zipf
from millrace.operators.index import TextIndex
from millrace.operators.pipeline import PipelineOptions, TextPipeline
from millrace.operators.store import StoreOptions
from millrace.sources import ingest
from millrace.streaming.incremental import stream_into_index

FRUIT = ["red apple", "green apple", "red banana"]
COURSES = ["machine learning with python", "deep learning neural networks", "cooking italian recipes"]


def index_of(spark, texts, options=PipelineOptions()):
    return TextIndex.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), options)


def ids(df):
    return [r["doc_id"] for r in df.collect()]


@pytest.fixture(scope="module")
def fruit(spark):
    return index_of(spark, [*FRUIT, ""])


@pytest.fixture(scope="module")
def courses(spark):
    return index_of(spark, COURSES)


def test_postings_and_statistics(spark):
    index = index_of(spark, ["hello hello world", "", None])
    assert {(r["term"], r["doc_id"], r["tf"]) for r in index.postings.collect()} == {("hello", 0, 2), ("world", 0, 1)}
    assert {r["doc_id"]: r["doc_len"] for r in index.doc_stats.collect()} == {0: 3, 1: 0, 2: 0}
    assert index.document_count().first()[0] == 3
    assert index.vocabulary_size().first()[0] == 2
    assert index.average_length().first()[0] == 1.0
    assert index.contains("hello") and not index.contains("zzz")
    assert {(r["term"], r["df"]) for r in index.document_frequencies().collect()} == {("hello", 1), ("world", 1)}


def test_empty_index(spark):
    index = index_of(spark, [])
    assert index.average_length().first()[0] == 0.0
    assert ids(ranking.search(index, ["a"])) == []


def test_pipeline(spark, courses):
    docs = spark.createDataFrame(list(enumerate(COURSES)), "doc_id long, text string")
    rows = {r["doc_id"]: r["terms"] for r in TextPipeline().terms(docs).collect()}
    assert rows[0] == ["machin", "learn", "with", "python"] and rows[1] == ["deep", "learn", "neural", "network"]
    lemmas = TextPipeline(PipelineOptions(lemmatize=True)).terms(spark.createDataFrame([(0, "mice were running")], "doc_id long, text string")).first()
    assert lemmas["terms"] == ["mouse", "be", "run"]
    assert courses.normalized(["Running", "Running"]) == ["run", "run"]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("(red OR green) AND NOT banana", [0, 1]),
        ("red green", [1]),
        ("red NOT banana", [0, 1, 3]),
        ("red AND", []),
        ("AND", []),
        ("NOT", []),
        ("", []),
        ("NOT zzz", [0, 1, 2, 3]),
        ("(red", [0, 2]),
        ("red)", [0, 2]),
        ("red OR green AND banana", [0, 2]),
        ("NOT red", [1, 3]),
        ("NOT NOT red", [0, 2]),
        ("red,", []),
        ("red and apple", [0]),
        ("And", []),
    ],
)
def test_boolean(fruit, query, expected):
    assert ids(boolean.boolean_query(fruit, query)) == expected


def test_boolean_algebra(fruit, spark):
    assert ids(boolean.search_and(fruit, ["red", "apple"])) == [0] and ids(boolean.search_and(fruit, [])) == []
    assert sorted(ids(boolean.search_or(fruit, ["green", "banana"]))) == [1, 2]
    assert sorted(ids(boolean.search_and_not(fruit, ["red"], ["banana"]))) == [0]
    assert sorted(ids(boolean.search_not(fruit, "red", fruit.documents.select("doc_id")))) == [1, 3]
    a, b = boolean.search_term(fruit, "red"), boolean.search_term(fruit, "apple")
    assert ids(boolean.intersect(a, b)) == [0] and sorted(ids(boolean.unite(a, b))) == [0, 1, 2] and sorted(ids(boolean.complement(fruit, a))) == [1, 3]


TREE = st.recursive(st.sampled_from(["red", "green", "apple", "zzz"]).map(boolean.Term), lambda x: st.one_of(x.map(boolean.Not), st.tuples(x, x).map(lambda p: boolean.Both(*p)), st.tuples(x, x).map(lambda p: boolean.Either(*p))), max_leaves=6)


def spell(tree) -> str:
    if isinstance(tree, boolean.Term):
        return tree.word
    if isinstance(tree, boolean.Not):
        return f"NOT ({spell(tree.of)})"
    return f"({spell(tree.left)}) {'AND' if isinstance(tree, boolean.Both) else 'OR'} ({spell(tree.right)})"


@settings(max_examples=100, deadline=None)
@given(TREE)
def test_parser_gives_the_tree_back(tree):
    assert boolean.parse(spell(tree)) == tree


def test_ranking(courses, spark):
    got = ranking.search(courses, "learning").collect()
    assert [(r["doc_id"], round(r["score"], 8)) for r in got] == [(0, 0.32192052), (1, 0.32192052)]
    assert round(ranking.search(courses, "learning learning").first()["score"], 8) == 0.64384104
    assert [round(r["score"], 8) for r in ranking.search(courses, "deep learning python").collect()] == [0.74520731, 0.74520731]
    index = index_of(spark, ["python python python", "python java cpp"])
    assert [(r["doc_id"], round(r["score"], 8)) for r in ranking.search(index, "python").collect()] == [(0, 1.0), (1, 0.33333333)]
    weights = ranking.term_weights(index_of(spark, ["cat dog", "cat", "bird"]), ["cat", "dog", "zzz", "cat"]).collect()
    assert [round(r["idf"], 8) for r in weights] == [1.28768207, 1.69314718, 0.0, 1.28768207]


def test_ranked_boolean_backfills(fruit):
    got = boolean.ranked_boolean_query(fruit, "NOT banana", 10).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(0, 0.0), (1, 0.0), (3, 0.0)]
    assert boolean.rank_words("(Love AND NOT war)") == ["love", "war"]


def words_table(spark, counts):
    return zipf.count_words(spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string"))


def test_zipf(spark):
    freqs = words_table(spark, {"the": 100, "of": 50, "and": 33, "to": 25})
    s = zipf.analyze(freqs).summary.first()
    assert (round(s["exponent"], 8), round(s["correlation"], 8)) == (1.00281892, 0.99996921)
    s = zipf.analyze(words_table(spark, {"frequent": 10, "common": 5, "rare": 1})).summary.first()
    assert (round(s["exponent"], 8), round(s["correlation"], 8)) == (1.97789418, 0.93018494)
    text = spark.createDataFrame([("the cat sat on the mat",)], "text string")
    s = zipf.analyze(zipf.word_frequencies(text)).summary.first()
    assert (s["total_words"], s["unique_words"]) == (6, 5)
    empty = zipf.analyze(words_table(spark, {"x": 1}).where("false")).summary.first()
    assert (empty["total_words"], empty["unique_words"], empty["type_token_ratio"], empty["exponent"]) == (0, 0, 0.0, 1.0)
    assert [r["rank"] for r in zipf.ranked_frequencies(words_table(spark, {"b": 2, "a": 2, "c": 1, "three": 3})).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert zipf.report(zipf.analyze(freqs)).startswith("=== Zipf Analysis ===\nTotal words: 208\n")


def test_zipf_law(spark):
    close = spark.createDataFrame([(i, 1.1 if i <= 5 else 2.0) for i in range(1, 11)], "rank long, ratio double")
    assert zipf.verify_law(close).first()["holds"]
    assert not zipf.verify_law(close.where("rank < 10")).first()["holds"]


@pytest.mark.parametrize(
    ("grades", "k", "expected"),
    [([2, 0, 1, 1], 3, (0.66666667, 2.5, 0.79848486, 0.77083333)), ([2, 0, 1, 1], 10, (0.75, 2.93067656, 0.93604034, 0.78255208)), ([0, 0], 5, (0, 0, 0, 0))],
)
def test_metrics(spark, grades, k, expected):
    ranked = spark.createDataFrame([(1, i + 1, g) for i, g in enumerate(grades)], "query_id long, rank int, grade int")
    got = {r["metric"]: round(r["value"], 8) for r in metrics.query_metrics(ranked, [k], 2).collect()}
    assert tuple(got[m] for m in metrics.METRICS) == pytest.approx(expected)


def plain_metrics(grades, k, most):
    top = grades[:k]
    dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g))
    ideal = dcg(sorted(grades, reverse=True)[:k])
    err, stays = 0.0, 1.0
    for i, g in enumerate(top):
        stop = (2**g - 1) / 2**most
        err, stays = err + stays * stop / (i + 1), stays * (1 - stop)
    return sum(g > 0 for g in top) / len(top), dcg(top), dcg(top) / ideal if ideal else 0.0, err


def test_metrics_against_a_loop(spark):
    lists = {1: [0, 1, 2, 2, 0, 1], 2: [2], 3: [0, 0, 0], 4: [1, 2, 0, 0, 0, 0, 0, 2, 1, 1, 2, 0]}
    ranked = spark.createDataFrame([(q, i + 1, g) for q, gs in lists.items() for i, g in enumerate(gs)], "query_id long, rank int, grade int")
    for r in metrics.query_metrics(ranked, [1, 3, 5, 10], 2).collect():
        want = dict(zip(metrics.METRICS, plain_metrics(lists[r["query_id"]], r["k"], 2), strict=True))
        assert r["value"] == pytest.approx(want[r["metric"]])
    table = metrics.metrics_table(metrics.average_metrics(metrics.query_metrics(ranked, [1, 3], 2)))
    assert table.splitlines()[0] == "Metric\t@1\t@3" and metrics.metrics_table(metrics.average_metrics(metrics.query_metrics(ranked.where("false"), [1], 2))) == "No metrics available"


def test_k_grid():
    assert evaluation.k_values(5) == [1, 3, 5] and evaluation.k_values(10) == [1, 3, 5, 10]
    assert evaluation.k_values(25) == [1, *range(2, 25, 2), 25] and evaluation.k_values(50_000)[:3] == [1, 5000, 10_000]


def test_evaluation(courses, spark):
    per, mean, n = evaluation.evaluate(courses, {1: "learning", 2: "zzz"}, top_k=5)
    assert n == 2 and {r["metric"]: r["value"] for r in mean.where("k = 1").collect()}["NDCG"] == 1.0
    qrels = spark.createDataFrame([(1, 1, 2)], "query_id long, doc_id long, grade int")
    _, mean, _ = evaluation.evaluate(courses, {1: "learning", 2: "zzz"}, qrels, top_k=5)
    assert {r["metric"]: r["value"] for r in mean.where("k = 3").collect()}["P"] == 0.25
    _, mean, _ = evaluation.evaluate(courses, {1: "deep AND learning"}, qrels, top_k=5, mode="boolean")
    assert {r["metric"]: r["value"] for r in mean.where("k = 1").collect()}["P"] == 1.0
    assert evaluation.synthetic_queries(5) == evaluation.synthetic_queries(5) and len(evaluation.synthetic_queries(50)) == 50


LINES = '{"id": "a", "poem": "red apple", "title": "T", "poet": "P", "date": 1901}\n\nnot json\n{"_id": "b", "text": "green apple", "name": "U"}\n{"content": "", "id": "c"}\n{"content": "red banana"}\n'


def test_ingest_index_search(spark, tmp_path, capsys):
    (tmp_path / "poems.jsonl").write_text(LINES)
    raw = ingest.read_jsonl(spark, str(tmp_path / "poems.jsonl"))
    assert raw.count() == 4 and ingest.read_jsonl(spark, str(tmp_path / "poems.jsonl"), limit=3).count() == 1
    docs = {r["external_id"]: r for r in ingest.extract_documents(raw).collect()}
    assert docs["a"]["year"] == "1901" and docs["a"]["author"] == "P" and docs["b"]["title"] == "U"
    args = ["--store", str(tmp_path / "docs"), "--index", str(tmp_path / "index")]
    assert cli.main(["ingest", "--jsonl", str(tmp_path / "poems.jsonl"), *args], spark) == 0
    saved = TextIndex.load(spark, str(tmp_path / "index"))
    assert sorted(ids(saved.documents)) == [0, 1, 2]
    cli.main(["search", "--index", str(tmp_path / "index"), "--query", "apple", "--format", "json"], spark)
    cli.main(["search", "--index", str(tmp_path / "index"), "--query", "red AND NOT apple", "--mode", "boolean"], spark)
    out = capsys.readouterr().out
    assert "red apple" in out and "green apple" in out and "(score: 0.0000)" in out
    more = TextIndex.append(spark, str(tmp_path / "index"), spark.createDataFrame([("x", "blue apple", "", "", "", 3)], "external_id string, text string, title string, author string, year string, doc_id long"))
    assert 3 in ids(ranking.search(more, "apple"))


def test_streaming(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    spark.createDataFrame([(0, "red apple")], "doc_id long, text string").write.parquet(source)
    stream = lambda: stream_into_index(spark.readStream.schema("doc_id long, text string").parquet(source), index, str(tmp_path / "cp")).awaitTermination(120)
    stream()
    spark.createDataFrame([(1, "green apple")], "doc_id long, text string").write.mode("append").parquet(source)
    stream()
    assert ids(ranking.search(TextIndex.load(spark, index), "apple")) == [0, 1]


def test_judged_queries(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text('[{"query": "love", "relevance": {"3": 2, "x": 1}}, {"query": "war", "description": "d", "relevance": {}}]')
    queries, qrels = ingest.load_test_queries(spark, str(path))
    assert queries.count() == 2 and [(r["doc_id"], r["grade"]) for r in qrels.collect()] == [(3, 2)]
    queries, _ = ingest.load_test_queries(spark, str(tmp_path / "none.json"))
    assert queries.count() == 0


def frequencies(index):
    return {r["term"]: r["df"] for r in index.document_frequencies().collect()}


def test_appends_are_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert TextIndex.load(spark, path).document_count().first()[0] == 0
    index_of(spark, ["red apple", "apple"]).save(path)
    once = frequencies(TextIndex.append(spark, path, docs([(2, "green apple")])))
    assert once["apple"] == 3 and frequencies(TextIndex.append(spark, path, docs([(2, "green apple")]))) == once
    TextIndex.append(spark, path, docs([(3, "pear")]), batch="b7")
    assert TextIndex.append(spark, path, docs([(4, "other")]), batch="b7").document_count().first()[0] == 4
    # a part that was written without its row in the log, as by a writer that died, isn't read
    index_of(spark, ["lost"])._write(path, StoreOptions())
    assert "lost" not in frequencies(TextIndex.load(spark, path))
    # a save takes the place of all before it
    index_of(spark, ["plum"]).save(path)
    assert frequencies(TextIndex.load(spark, path)) == {"plum": 1}
    assert TextIndex.clear(spark, path).document_count().first()[0] == 0
    added = TextIndex.add(spark, path, spark.createDataFrame([("b",), ("a",), ("",)], "text string"))
    assert {(r["doc_id"], r["text"]) for r in added.documents.collect()} == {(0, "a"), (1, "b")}
    more = TextIndex.add(spark, path, spark.createDataFrame([("c",)], "text string"))
    assert sorted(ids(more.documents)) == [0, 1, 2]


@pytest.mark.parametrize("compress", [True, False])
def test_stored_forms(spark, tmp_path, compress):
    docs = spark.createDataFrame([(0, "Grüße, Welt", "T"), (1, "", None), (2, None, "U")], "doc_id long, text string, title string")
    index = TextIndex.build(docs)
    path = str(tmp_path / "index")
    got = {r["doc_id"]: (r["text"], r["title"]) for r in index.save(path, StoreOptions(compress=compress)).documents.collect()}
    assert got == {0: ("Grüße, Welt", "T"), 1: ("", None), 2: (None, "U")}
    assert ("packed" in spark.read.parquet(f"{path}/parts/*/documents").columns) == compress
    bare = index.save(path, StoreOptions(documents=False, compress=compress, titles=False))
    assert {(r["doc_id"], r["text"], r["title"]) for r in bare.documents.collect()} == {(0, "", ""), (1, "", ""), (2, "", "")}
    assert ids(ranking.search(bare, "welt")) == [0]


def test_many_boolean_queries_at_once(fruit):
    asked = {1: "(red OR green) AND NOT banana", 2: "red AND", 3: "NOT zzz", 4: "apple", 5: "zzz"}
    got = {}
    for r in boolean.batch_boolean(fruit, asked).collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert {q: sorted(d) for q, d in got.items()} == {q: found for q, text in asked.items() if (found := ids(boolean.boolean_query(fruit, text)))}
    ranked = boolean.batch_ranked_boolean(fruit, {1: "NOT banana", 2: "red OR apple"}, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in ranked] == [(q, r["doc_id"]) for q, text in ((1, "NOT banana"), (2, "red OR apple")) for r in boolean.ranked_boolean_query(fruit, text, 2).collect()]
    assert fruit.batch_terms({1: "Running apples", 2: "", 3: "apples apples"}) == {1: ["run", "apple"], 2: [], 3: ["apple", "apple"]}


def test_a_query_that_cannot_be_asked_is_left_out(courses):
    told = []
    per, mean, n = evaluation.evaluate(courses, {1: "learning", 2: None}, top_k=5, progress=lambda share, _: told.append(share))
    assert n == 2 and {r["query_id"] for r in per.collect()} == {1} and told == sorted(told) and told[0] == 0 and told[-1] == 1


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs = lambda rows: spark.createDataFrame(rows, "external_id string, text string")
    ingest.upsert(docs([("a", "1"), ("b", "1")]), path)
    told = []
    got = ingest.upsert(docs([("b", "2"), ("b", "3"), ("c", "1")]), path, progress=lambda share, _: told.append(share))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "1"), ("b", "3"), ("c", "1")] and told[-1] == 1.0
