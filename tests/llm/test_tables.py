"""Sharding, packing, mixing, quality rules, URL filters and chats."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import kd_sharding, mixing, packing, quality_rules, sql, url_filter
from millrace.llm.chat_format import ChatTemplate, RoleStyle, format_chats, read_back
from millrace.llm.common import numbered
from millrace.llm.queries import LISTED, oracle_sql, queries

from llm_helpers import DOCS, SF, rows_of, sentence


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot source, a group of copies of a third of all rows, and one long text."""
    rng = random.Random(8)
    copy = sentence(rng, 30)
    texts = [copy if i % 3 == 0 else sentence(rng, rng.randrange(1, 90)) for i in range(900)] + [sentence(rng, 2000)]
    rows = [(i, t, rng.choice(["en", "en", "de"]), "hot" if i % 2 else f"s{i % 17}", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(6)


# sharding


def test_shards_are_even_and_slots_gapless(skewed):
    rows = kd_sharding.kd_shards(skewed, 8).collect()
    size, slots = Counter(), defaultdict(list)
    texts = {r["doc_id"]: r["text"] for r in skewed.collect()}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes"
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 901 and set(size) == set(range(8))
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_copies_share_a_shard_unless_cut(spark):
    rng = random.Random(2)
    groups = [sentence(rng, 20) for _ in range(100)]
    df = spark.createDataFrame([(i, g, rng.choice(["en", "de", "fr"]), f"s{rng.randrange(20)}", 0) for i, g in enumerate(g for g in groups for _ in range(5))], DOCS)
    rows = kd_sharding.kd_shards(df, 6).collect()
    found = defaultdict(set)
    for r in rows:
        found[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in found.values()) <= 5


def test_copies_of_the_table_share_a_shard(spark):
    rows = queries()["op5_kd_sharding"](spark, "/root/testdata/sf0.1").collect()
    found, size = defaultdict(set), Counter()
    for r in rows:
        found[r["text_crc32"]].add(r["shard"])
        size[r["shard"]] += r["size"]
    assert len(rows) == 10_000 and sum(len(s) > 1 for s in found.values()) <= 39
    assert max(size.values()) - min(size.values()) <= max(0.02 * sum(size.values()) / 40, max(r["size"] for r in rows))


def test_equal_rows_are_spread(spark):
    rng = random.Random(3)
    text = sentence(rng, 12)
    rows = [(7, text, "en", "s", 0)] * 4000 + [(i, sentence(rng, 12), "en", "s", 0) for i in range(10, 1010)]
    got = kd_sharding.kd_shards(spark.createDataFrame(rows, DOCS).repartition(5), 40).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == 5000 and len(size) == 40 and max(size.values()) - min(size.values()) <= 0.1 * sum(size.values()) / 40


def plain_tree(points, shards, position):
    """A k-d tree by sorting: points (key, codes, place, bytes) to {key: shard}."""
    if shards == 1 or not points:
        return {p[0]: 0 for p in points}

    def width(d):
        total = sum(p[3] for p in points)
        mean = sum(p[3] * position[d][p[1][d]] for p in points) / total
        return sum(p[3] * (position[d][p[1][d]] - mean) ** 2 for p in points) / total

    d = max(range(3), key=lambda d: (round(width(d), 12), -d))
    points = sorted(points, key=lambda p: (p[1][d], p[2]))
    goal, before, at = sum(p[3] for p in points) * (shards // 2) / shards, 0, 0
    while at < len(points):
        own = [p for p in points[at:] if (p[1][d], p[2]) == (points[at][1][d], points[at][2])]
        if before + sum(p[3] for p in own) >= goal:
            if before + sum(p[3] for p in own) - goal < goal - before:
                at += len(own)
            break
        before, at = before + sum(p[3] for p in own), at + len(own)
    left, right = plain_tree(points[:at], shards // 2, position), plain_tree(points[at:], shards - shards // 2, position)
    return left | {k: s + shards // 2 for k, s in right.items()}


@pytest.mark.parametrize("shards", [2, 7, 40])
def test_tree_is_that_of_a_plain_one(spark, skewed, shards):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(skewed.select(F.col("doc_id") + 10_000, "text", "lang", "source").toDF("doc_id", "text", "lang", "source"))
    rows = rows.select("doc_id", F.col("doc_id").alias("uid"), (F.octet_length("text") + 16).cast("long").alias("size"), F.xxhash64("text").alias("h"), "lang", "source")
    _, points = kd_sharding.sliced(rows, 2000.0)
    plain = [((r["h"], r["slice"]), (r["c0"], r["c1"], r["c2"]), r["place"], r["bytes"]) for r in points.collect()]
    position = []
    for d in range(3):
        total, below, out = sum(p[3] for p in plain), 0, {}
        for c in sorted({p[1][d] for p in plain}):
            own = sum(p[3] for p in plain if p[1][d] == c)
            out[c], below = (below + own / 2) / total, below + own
        position.append(out)
    tree = kd_sharding.build_tree(points, shards, 1e-6)
    got = {(r["h"], r["slice"]): r["shard"] for r in kd_sharding.place_points(points, tree).collect()}
    assert got == plain_tree(plain, shards, position) and set(got.values()) == set(range(shards))


def test_sharding_is_the_same_for_any_order_and_takes_target_bytes(skewed):
    a = {r["doc_id"]: r["shard"] for r in kd_sharding.kd_shards(skewed, 5).collect()}
    assert a == {r["doc_id"]: r["shard"] for r in kd_sharding.kd_shards(skewed.orderBy(F.desc("doc_id")).repartition(2), 5).collect()}
    total = skewed.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    assert kd_sharding.kd_shards(skewed, target_bytes=total // 4 + 1).agg(F.max("shard")).first()[0] == 3


def test_sharding_odd_rows(odd_docs, no_docs):
    rows = kd_sharding.kd_shards(odd_docs, 3).collect()
    assert len(rows) == 11 and [(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 1] == [(16, None)]
    assert kd_sharding.kd_shards(no_docs, 3).collect() == [] and kd_sharding.kd_shards(no_docs, target_bytes=9).collect() == []
    with pytest.raises(ValueError):
        kd_sharding.kd_shards(odd_docs)


def test_numbering(spark):
    df = spark.createDataFrame([(i % 3 if i % 10 else None, i) for i in range(500)], "g int, id long")
    rows = numbered(df, "g", ["id"], "at", 7).collect()
    found = defaultdict(list)
    for r in rows:
        found[r["g"]].append(r["at"])
    assert len(rows) == 500 and all(sorted(v) == list(range(len(v))) for v in found.values())


# packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(hist, k):
    import itertools

    lengths = sorted(hist)
    cost = lambda ends: sum(n * min(e for e in ends if e >= x) for x, n in hist.items())
    best = min(cost([*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], m))
    got = packing.best_boundaries(lengths, [hist[x] for x in lengths], k)
    assert len(got) <= k and cost(got) == best


def test_packing(skewed):
    rows = packing.pack(skewed, budget=512, buckets=4, align=8).collect()
    batches = defaultdict(list)
    for r in rows:
        batches[r["bucket"], r["batch"]].append(r)
    assert len(rows) == 901 and {r["n_tokens"] for r in rows if r["bucket"] == -1} == {2000}
    for (bucket, _), own in batches.items():
        assert sorted(r["place"] for r in own) == list(range(len(own)))
        assert len({r["padded"] for r in own}) == 1 and all(r["padded"] >= r["n_tokens"] for r in own)
        assert sum(r["padded"] for r in own) <= 512 or (bucket == -1 and len(own) == 1)
    for b in {r["bucket"] for r in rows} - {-1}:
        full = sorted((k[1] for k in batches if k[0] == b))
        room = 512 // batches[b, 0][0]["padded"]
        assert full == list(range(len(full))) and all(len(batches[b, i]) == room for i in full[:-1])


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_packing_query_against_a_plain_loop(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    docs = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries()["op6_length_packing"](spark, sf).collect()}
    assert {i: r["n_tokens"] for i, r in rows.items()} == docs
    hist = Counter(max(1, -(-n // 8)) * 8 for n in docs.values())
    lengths = sorted(hist)
    assert lengths[-1] <= 32768
    # least total length with k buckets for the first j lengths, by trying every last boundary
    least = [0] + [float("inf")] * len(lengths)
    for _ in range(16):
        new = [0] + [float("inf")] * len(lengths)
        for j in range(1, len(lengths) + 1):
            n = 0
            for i in range(j - 1, -1, -1):
                n += hist[lengths[i]]
                new[j] = min(new[j], least[i] + n * lengths[j - 1])
        least = [min(a, b) for a, b in zip(least, new, strict=True)]
    assert sum(r["padded"] for r in rows.values()) == least[-1]
    ends = sorted({r["padded"] for r in rows.values()})
    found = defaultdict(list)
    for i, r in rows.items():
        assert r["padded"] == min(e for e in ends if e >= docs[i]) and r["bucket"] == ends.index(r["padded"])
        found[r["bucket"], r["batch"]].append(r["place"])
    for b, end in enumerate(ends):
        room, n = 32768 // end, sum(r["bucket"] == b for r in rows.values())
        assert [sorted(found[b, k]) for k in range(-(-n // room))] == [list(range(min(room, n - k * room))) for k in range(-(-n // room))]


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    assert len(rows) == 11 and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0} and any(r["bucket"] == -1 for r in rows)
    assert packing.pack(no_docs).collect() == []
    assert packing.pack(odd_docs.withColumn("t", F.lit(None).cast("int")), tokens_col="t").count() == 11


# mixing


def plain_rake(cells, goals, sweeps):
    total = sum(cells.values())
    factors = [[1.0] * len(g) for g in goals]
    goals = [[x if any(c[d] == i and t > 0 for c, t in cells.items()) else 0.0 for i, x in enumerate(g)] for d, g in enumerate(goals)]
    goals = [[x / sum(g) for x in g] for g in goals]
    weight = lambda c: factors[0][c[0]] * factors[1][c[1]] * factors[2][c[2]]
    for _ in range(sweeps):
        for d, g in enumerate(goals):
            for i, x in enumerate(g):
                factors[d][i] = 1.0
                have = sum(t * weight(c) for c, t in cells.items() if c[d] == i)
                factors[d][i] = x * total / have if have > 0 else 0.0
    w = {c: t * weight(c) for c, t in cells.items()}
    return {c: x / sum(w.values()) for c, x in w.items()}


def test_raking_meets_the_marginals():
    rng = random.Random(1)
    cells = {(a, b, c): float(rng.randrange(1, 1000)) for a in range(3) for b in range(2) for c in range(3)}
    goals = [[0.2, 0.5, 0.3], [0.6, 0.4], [0.1, 0.1, 0.8]]
    got = {(r[0], r[1], r[2]): r[3:] for r in mixing.cell_table(cells, goals, 0.9)}
    want = plain_rake(cells, goals, 60)
    assert all(got[c][0] == pytest.approx(want[c], abs=1e-9) and max(map(abs, got[c][2:])) < 1e-9 for c in cells)
    kept = {c: cells[c] * got[c][1] for c in cells}
    for d, g in enumerate(goals):
        for i, x in enumerate(g):
            assert sum(t for c, t in kept.items() if c[d] == i) == pytest.approx(x * sum(kept.values()), rel=1e-6)
    # the scarcest cell is kept whole, or the budget is reached
    assert max(p for _, p, *_ in got.values()) == pytest.approx(1) or sum(kept.values()) == pytest.approx(0.9 * sum(cells.values()))
    small = {(r[0], r[1], r[2]): r[4] for r in mixing.cell_table(cells, goals, 0.05)}
    assert sum(cells[c] * p for c, p in small.items()) == pytest.approx(0.05 * sum(cells.values()), rel=1e-9)


def test_contradicting_targets_leave_a_residual():
    cells = {(0, 0, 0): 50.0, (1, 1, 0): 50.0}  # sources and languages coincide
    rows = mixing.cell_table(cells, [[0.2, 0.8], [0.6, 0.4], [1.0]], 0.9)
    assert max(abs(x) for r in rows for x in r[5:]) > 0.1 and all(0 <= r[4] <= 1 for r in rows)
    assert mixing.cell_table({}, [[1.0], [1.0], [1.0]], 0.9) == [] and mixing.cell_table({(0, 0, 0): 0.0}, [[1.0], [1.0], [1.0]], 0.9)[0][4] == 1.0


def test_mixing(skewed):
    spec = {"source": {"hot": 0.2, "*": 0.8}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 0.7, "short": 0.2, "*": 0.1}}
    rows = mixing.mix(skewed, spec, budget_share=0.05).collect()
    assert len(rows) == 901
    tokens = sum(r["n_tokens"] for r in rows)
    assert sum(r["n_tokens"] * r["prob"] for r in rows) == pytest.approx(0.05 * tokens, rel=1e-6)
    rows = mixing.mix(skewed, spec).collect()
    again = {r["doc_id"] for r in mixing.sampled(skewed.repartition(3), spec).collect()}
    assert again == {r["doc_id"] for r in rows if r["sampled"]} and 0 < len(again) < 901
    assert mixing.sampled(skewed, spec).columns == skewed.columns


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_mixing_query_against_plain_raking(spark, sf):
    """Cells and probabilities of the registered query by a plain loop over the whole table; the targets are reached."""
    sf = f"/root/testdata/sf{sf}"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries()["op8_source_mixing"](spark, sf).collect()}
    assert set(rows) == set(docs)
    names = [[*(k for k in mixing.TARGETS[d] if k != "*"), "*"] for d in mixing.DIMS]
    cells, cell, n = Counter(), {}, {}
    for i, r in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        bars = (r["text"] or "").count("|")
        topic = "tabular" if 10 * bars > len(words) else "short" if len(words) < 50 else "long" if len(words) > 1000 else "prose"
        n[i], own = len(words), (r["source"], r["lang"], topic)
        cell[i] = tuple(k.index(x) if x in k else len(k) - 1 for k, x in zip(names, own, strict=True))
        cells[cell[i]] += len(words)
        assert (rows[i]["n_tokens"], rows[i]["topic"]) == (len(words), topic)
    goals = [[mixing.TARGETS[d][k] for k in own] for d, own in zip(mixing.DIMS, names, strict=True)]
    weight, total = plain_rake(cells, goals, 300), sum(cells.values())
    scale = min([0.9, *(t / total / weight[c] for c, t in cells.items() if t and weight[c])])
    for i, r in rows.items():
        c = cell[i]
        assert r["weight"] == pytest.approx(weight[c], abs=1e-6) and r["prob"] == pytest.approx(min(1, scale * weight[c] * total / cells[c]) if cells[c] else 1, abs=1e-4)
        assert max(abs(r[f"{d}_residual"]) for d in mixing.DIMS) < 1e-6
    expected = sum(n[i] * r["prob"] for i, r in rows.items())
    report = {(r["dimension"], r["category"]): r for r in mixing.mixing_report(spark.createDataFrame(list(rows.values()))).collect()}
    for d, (goal, own) in enumerate(zip(goals, names, strict=True)):
        there = [i for i in range(len(own)) if any(c[d] == i and t for c, t in cells.items())]
        for i in there:
            reached = sum(n[x] * r["prob"] for x, r in rows.items() if cell[x][d] == i) / expected
            assert reached == pytest.approx(goal[i] / sum(goal[j] for j in there), abs=0.01)
            assert report[mixing.DIMS[d], own[i]]["expected"] == pytest.approx(reached, abs=1e-9)
    if len(docs) > 5000:  # what was drawn is off by chance only
        assert all(abs(r["sampled"] - r["expected"]) < 0.03 for r in report.values())


def test_mixing_odd_rows(odd_docs, no_docs):
    assert mixing.mix(odd_docs).count() == 11 and mixing.mix(no_docs).collect() == []
    assert mixing.sampled(no_docs).collect() == [] and mixing.sampled(odd_docs).columns == odd_docs.columns
    assert mixing.mix(odd_docs.where("doc_id = 1")).first()["sampled"]


# quality rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)})


@pytest.mark.parametrize("seed", [1, 2])
def test_counts(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("a bb ccc d# é|ü\n \t \n\n x\ny $".split(" ")) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [" ".join(rng.choice("ab") for _ in range(2000)), " ".join(str(i // 2 % 900) for i in range(5000)), "a b c " * 40, None, "", "a", "a b", "a\nb\na", "x y z\n" * 3]
    rows = quality_rules.text_counts(spark.createDataFrame(rows_of(texts), DOCS)).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(texts[r["doc_id"]])


def test_bounds_fall_back_and_clean_texts_stay(spark):
    rng = random.Random(4)
    clean = [(i, sentence(rng, 80), "en" if i % 4 else "de", "big" if i < 300 else f"s{i % 5}", 0) for i in range(400)]
    junk = [(1000 + i, " ".join(f"w{rng.randrange(999)}***" for _ in range(80)), "en", "big" if i % 2 else "lone", 0) for i in range(20)]
    rows = quality_rules.quality_rules(spark.createDataFrame(clean + junk, DOCS)).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert all(kept[i] for i in range(400)) and not any(kept[1000 + i] for i in range(20))
    assert all(r["failed_rules"] == ["symbols_per_word"] for r in rows if r["doc_id"] >= 1000)


def test_rules_odd_rows(odd_docs, no_docs):
    rows = quality_rules.quality_rules(odd_docs).collect()
    assert len(rows) == 11 and all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert quality_rules.quality_rules(no_docs).collect() == []


# URL filters


def test_hosts_and_listed_rules(spark):
    urls = ["HTTP://WWW.Example.com/en/x?a#b", "http://example.com/en/", "https://a.example.com/de", "x://b.net/es/1", "no scheme", None, "://", "a://h?q", "a://com/", "a://xcom/", "a://b.com", "a://x.org/p://q/r"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = url_filter.mine_rules(df.withColumn("bad", F.lit(0)))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, LISTED, none).collect()}
    assert got == {
        0: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 1: ("example.com", "/en/", "example.com/en/", "block"), 2: ("a.example.com", "/de", "com/", "allow"),
        3: ("b.net", "/es/1", "net/es/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("h", "", None, "allow"),
        8: ("com", "/", "com/", "allow"), 9: ("xcom", "/", None, "allow"), 10: ("b.com", "", None, "allow"), 11: ("x.org", "/p://q/r", None, "allow"),
    }


def test_mined_rules(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        host, folder = rng.choice(["pills", "news", "blog"]), rng.choice(["buy", "read", "cheap"])
        bad = (host == "pills" and folder == "buy") and rng.random() < 0.95 or rng.random() < 0.05
        rows.append((i, f"https://{host}{''}.site.org/{folder}/{i}?utm={i}", int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    mined = url_filter.mine_rules(df, min_support=0.01)
    assert all({"h:pills", "p:buy"} <= set(r["items"]) for r in mined.collect()) and not mined.isEmpty()
    got = url_filter.filter_urls(df.unionByName(df.limit(3)), [], mined).collect()
    assert len(got) == 1503 and all((r["verdict"] == "block") == ("pills" in r["host"] and "/buy/" in r["path"]) == (r["confidence"] is not None) for r in got)
    # brute force: every rule against every URL
    tokens = {r["page_id"]: set(r["t"]) for r in df.select("page_id", url_filter.url_tokens(F.col("url")).alias("t")).collect()}
    rules = [(set(r["items"]), r["confidence"]) for r in mined.collect()]
    assert all((r["confidence"] or 0) == max([c for s, c in rules if s <= tokens[r["page_id"]]], default=0) for r in got)
    assert url_filter.filter_urls(df.where("false"), LISTED, mined).collect() == []
    assert url_filter.mine_rules(df.where("false")).collect() == []


def plain_rules(bags, least, confidence, lift):
    """Association rules of (tokens, bad) by counting every combination."""
    import itertools

    both, alone = Counter(), Counter()
    for tokens, bad in bags:
        for k in range(1, len(tokens) + 1):
            for items in itertools.combinations(sorted(tokens), k):
                alone[items] += 1
                both[items] += bad
    share = sum(bad for _, bad in bags) / len(bags)
    found = {i: (n / alone[i], n / alone[i] / share, n / len(bags)) for i, n in both.items() if n >= least and n / alone[i] >= confidence and n / alone[i] / share >= lift}
    return {i: x for i, x in found.items() if len(i) == 1 or not any((t,) in found and found[t,][0] >= x[0] for t in i)}


def test_mined_rules_against_every_combination(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        host, folder, key = rng.choice(["pills", "news", "blog"]), rng.choice(["buy", "read", "cheap"]), rng.choice(["utm", "id", "ref"])
        rows.append((i, f"https://{host}.site.org/{folder}/{i}?{key}={i}", int(rng.random() < {"pills": 0.5, "news": 0.1, "blog": 0.2}[host] + 0.4 * (folder == "buy") + 0.1 * (key == "id"))))
    rows += [(500, None, 1), (501, "https://pills.site.org/buy", None), (502, "none", 1), (503, "https://pills.site.org/" + "buy/" * 5000, 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, bad int, items string, confidence string")
    bags = [(r["t"], r["bad"]) for r in df.where("url IS NOT NULL AND bad IS NOT NULL").select(url_filter.url_tokens(F.col("url")).alias("t"), "bad").collect() if r["t"]]
    for confidence, lift in ((0.3, 1.0), (0.6, 1.5)):
        want = plain_rules(bags, 10, confidence, lift)
        got = url_filter.mine_rules(df, min_confidence=confidence, min_lift=lift).collect()
        assert len(got) == len(want) > 0
        for r in got:
            assert (r["confidence"], r["lift"], r["support"]) == pytest.approx(want[tuple(r["items"])])
            assert r["filed_under"] == min(r["items"], key=lambda t: (sum(t in own for own, _ in bags), t))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_mining_of_the_query_against_sql(spark, sf):
    """Thresholds that the tables' rules do reach, on both sides; the registered ones leave no rule there."""
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf{sf}/{t}.parquet'")
    pages, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("pages", "labels"))
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(((F.min("quality") == 0) | (F.max("toxic") == 1)).cast("int").alias("bad"))
    mined = url_filter.mine_rules(pages.join(bad, "page_id").select("url", "bad"), min_confidence=0.25, min_lift=1.0)
    df = url_filter.filter_urls(pages, LISTED, mined)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert any(r[cols.index("mined_rule")] for r in got)
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql._op7(min_confidence=0.25, min_lift=1.0)})").fetchall(), key=repr)


def test_urls_odd_rows(spark):
    rules = spark.createDataFrame([(["h:zz"], 0.9, 2.0, 0.1, "h:zz"), (["h:aa"], 0.9, 2.0, 0.1, "h:aa"), (["h:bb"], 0.9, 2.0, 0.2, "h:bb")], "items array<string>, confidence double, lift double, support double, filed_under string")
    urls = [(1, "https://aa.zz/"), (1, "https://aa.zz/"), (None, "https://zz/"), (2, None), (3, "https://aa.zz.bb/" + "x/" * 100_000), (4, "")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in urls], "page_id long, url string, host string, rule string, tokens string")
    got = sorted(((r["page_id"], r["mined_rule"], r["verdict"]) for r in url_filter.filter_urls(df, [], rules).collect()), key=repr)
    # equally sure rules: the one with more support, then the first by name
    assert got == sorted([(1, "h:aa", "block"), (1, "h:aa", "block"), (None, "h:zz", "block"), (2, None, "allow"), (3, "h:bb", "block"), (4, None, "allow")], key=repr)


# chats


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, state string, seg string")


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


CONVERSATIONS = {
    1: ([("system", "be kind"), ("user", "hi"), ("assistant", "hello")], True),
    2: ([("user", "[INST] </s> \\[INST]"), ("assistant", "<\\s><<SYS>>\n<|im_end|>")], True),
    3: ([("assistant", "first")], False),
    4: ([("user", "a"), ("user", "b"), ("assistant", "c")], False),
    5: ([("tool [AS] x", "t</s>"), ("user", ""), ("assistant", "")], False),
    6: ([("user", "only asked")], False),
    7: ([("user", "ü" * 300_000), ("assistant", "é\n\n")], True),
}


def test_formatting(spark):
    rows = [(c, i, role, text) for c, (turns, _) in CONVERSATIONS.items() for i, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    segments = format_chats(chats(spark, rows))
    got = {r["conv_id"]: r for r in read_back(segments).collect()}
    whole = segments.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()
    assert {r["conv_id"]: r["n"] for r in whole} == {c: r["formatted_chars"] for c, r in got.items()}
    for c, (turns, valid) in CONVERSATIONS.items():
        said = [t for r, t in turns if r == "assistant"]
        assert got[c]["n_turns"] == len(turns) and got[c]["valid"] == valid
        assert got[c]["turns_sha256"] == digest(f"{r}\n{t}\n" for r, t in turns)
        assert got[c]["loss_sha256"] == digest(said) and got[c]["loss_chars"] == sum(map(len, said))
    controls = ChatTemplate().control_strings()
    assert not any(x in r["text"] for r in segments.where("kind = 'text'").collect() for x in controls)


def test_chat_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b")]
    got = {r["conv_id"]: r for r in read_back(format_chats(chats(spark, rows))).collect()}
    assert got[None]["n_turns"] == 1 and got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == digest(["\n\n", "user\nb\n", "user\nb\n"])
    assert read_back(format_chats(chats(spark, []))).collect() == []
    with pytest.raises(ValueError):
        format_chats(chats(spark, []), ChatTemplate(roles={"user": RoleStyle("[U]", "[/U]")}))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>[]/\\sINSTYan|im_end", max_size=60) | st.lists(st.sampled_from(["<s>", "</s>", "\\", "<", "[INST]", "[", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\s>", "<|im_end|>", "x"]), max_size=9).map("".join))
def test_escaping_is_reversible(text):
    escape, unescape = ChatTemplate().codec()
    hidden = escape(text)
    assert unescape(hidden) == text and not any(c in hidden for c in ChatTemplate().control_strings())


# registered queries with SQL


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("name", ["op5_kd_sharding", "op6_length_packing", "op7_url_filter", "op8_source_mixing"])
def test_other_queries_cover_their_tables(spark, name):
    table = "pages" if "url" in name else "documents"
    assert queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
