"""The plumbing of the operators: filters, samples, components, word scanning."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from keyspan.llm import tables, textscan


def test_filter_has_no_false_misses(spark):
    df = spark.range(0, 20_000, 3).select((F.xxhash64("id")).alias("k"))
    f = tables.Filter.over(df, "k").value
    keys = np.array([r.k for r in df.collect()], np.int64)
    assert f.has(keys).all()
    others = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 50_000)
    assert f.has(others).mean() < 0.001
    assert not tables.Filter.over(df.limit(0), "k").value.has(others).any()


def test_samples_are_bounded_and_repeat(spark):
    df = spark.range(30_000)
    a = tables.hash_sample(df, 2_000, "id")
    assert 1_500 < a.count() <= 2_000
    assert {r.id for r in a.collect()} == {r.id for r in tables.hash_sample(df.repartition(5), 2_000, "id").collect()}
    assert tables.hash_sample(df, 40_000, "id").count() == 30_000


def test_samples_count_a_hot_row_once(spark):
    df = spark.range(30_000).selectExpr("'same' as url").unionByName(spark.range(5_000).selectExpr("cast(id as string) as url"))
    assert tables.hash_sample(df, 1_000, "url").count() <= 1_000
    assert tables.hash_sample(df, 6_000, "url").count() == 5_001


def test_spread_join(spark):
    many = tables.written(spark.range(3_000).selectExpr("if(id % 3 = 0, 1, id) as k", "id as v"), "many")
    one = spark.range(0, 3_000, 2).selectExpr("id as k", "id * 10 as x").unionByName(spark.createDataFrame([(1, -1)], "k long, x long"))
    hot = tables.hot_keys(many, ["k"], least=100)
    assert [(r.k, r.spread_parts) for r in hot.collect()] == [(1, 11)]  # 1,000 multiples of 3, and 1 itself
    for how in ("inner", "left"):
        a = tables.spread_join(many, one, ["k"], hot, how)
        b = many.join(one, ["k"], how)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    tables.dropped(many)


def test_names_that_are_free():
    assert tables.fresh(["rid", "RTH", "rth_"], "rid", "rth", "x", "x") == ["rid_", "rth__", "x", "x_"]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    loops = {x for a, b in edges if a == b for x in (a,)}
    want = {x: find(x) for x in list(root)}
    assert all(got.get(x, x) == c for x, c in want.items()) and set(want) - set(got) <= loops
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_few_tasks(spark):
    edges = tables.written(spark.range(300).selectExpr("id as a", "id + 1 as b"), "chain")
    spark.sparkContext.setJobGroup("few", "")
    got = tables.components(edges).collect()
    spark.sparkContext.setJobGroup("many", "")
    rounds = tables.components(edges, few=0).collect()
    spark.sparkContext.setJobGroup("", "")
    assert sorted(got) == sorted(rounds) == [(i, 0) for i in range(301)]
    told = spark.sparkContext.statusTracker()
    stages = {k: sum(len(told.getJobInfo(j).stageIds) for j in told.getJobIdsForGroup(k)) for k in ("few", "many")}
    assert stages["few"] <= 10 < stages["many"]


def test_components_by_rounds_and_at_once(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(-(2**62), 2**62, (50, 2))] + [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(2000, 2000 + i) for i in range(1, 150)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(tables.components(df).collect()) == sorted(tables.components(df, few=0).collect())
    stars = spark.createDataFrame([(i % 7, 10 + i) for i in range(90)], "a long, b long")
    assert sorted(tables.components(stars, few=0).collect()) == sorted([(i, i) for i in range(7)] + [(10 + i, i % 7) for i in range(90)])
    assert tables.components(spark.createDataFrame([], "a long, b long"), few=-1).count() == 0


def test_scan_matches_plain_splitting():
    rng = np.random.default_rng(4)
    alphabet = list("abAZé\x0b\x0c\t\n\r  \x1c\x85日")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 80))) for _ in range(400)] + [None, "", "x" * 3_000_000 + " y"]
    column = pa.array(texts, pa.string())
    seen = {}
    for lower in (False, True):
        for w in textscan.scan_words(column, lower):
            h = w.hashes()
            for d in range(w.hi - w.lo):
                raw = (texts[w.lo + d] or "").encode()
                words = (raw.lower() if lower else raw).split()
                got = [bytes(w.buf[s:e]) for s, e in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]], strict=True)]
                assert [g.lower() if lower else g for g in got] == words
                for word, value in zip(words, h[w.first[d] : w.first[d + 1]], strict=True):
                    assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64)
    for w in (1, 2, 3, 5, 9, 16, 100):
        assert (textscan.sliding_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()
    assert len(textscan.sliding_min(x[:3], 9)) == 0
