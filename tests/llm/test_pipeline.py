"""The pipeline's stages, each against a plain version on its own input."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyspan.llm import decontaminate, quality_rules
from tests.llm import brute

STAGES = dict(corpus_pipeline.STAGES)
CLASHING = ("rid", "rth", "kept", "copies", "key", "id", "th", "spans", "times", "doc", "group", "changed_text", "source_key", "Row")


def without_hits(text, items, span=13):
    """The text after the stage, None if it goes."""
    _, n_hit, _ = brute.contamination([(0, text)], items)[0]
    words = brute.folded(text)
    if n_hit > 0 and 20 * n_hit >= len(words):
        return None
    if not n_hit:
        return text
    wins = set()
    for _, t in items:
        w = brute.folded(t)
        n = min(span, len(w))
        wins |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1 if n else 0)}
    hit = {p for n in {len(x) for x in wins} for j in range(len(words) - n + 1) if tuple(words[j : j + n]) in wins for p in range(j, j + n)}
    out, at = [], 0
    for i, m in enumerate(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)):
        if i not in hit:
            out.append(text[at : m.end()])
        at = m.end()
    return "".join(out) + text[at:]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        judged = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()} if n == 0 else None
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if n < 4:
            assert docs.columns == columns
        if n == 0:
            assert {i for i, _ in after} == judged
        elif n == 1:
            groups = brute.components(before)
            assert {i for i, _ in after} == {i for i, (_, c) in groups.items() if i == c}
        elif n == 2:
            want = brute.without_repeats(before)
            assert len(after) == len(before)
            for i, t in after:
                words = brute.plain(t)
                assert hashlib.sha256(" ".join(words).encode()).hexdigest() == want[i][2]
            assert all(r.n_chars == len(r.text or "") for r in docs.collect() if want[r.doc_id][1])
        elif n == 3:
            want = {i: without_hits(t, items) for i, t in before}
            assert dict(after) == {i: t for i, t in want.items() if t is not None}
        else:
            times = Counter(i for i, _ in after)
            assert set(times.values()) <= {1, 2} and set(times) <= {i for i, _ in before}
            words = {i: len(brute.plain(t)) for i, t in before}
            taken = sum(words[i] * k for i, k in times.items())
            assert abs(taken - 1.5 * sum(words.values())) < 0.1 * sum(words.values())
    assert decontaminate.SPAN == 13


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.fixture(scope="module")
def odd(spark, sf_dir, tmp_path_factory):
    """Rows with nulls, repeats, ids with several texts, and columns that a stage might use itself; a benchmark for them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = [(r.doc_id, r.text, r.lang, r.source) for r in docs.where("n_chars > 400").limit(30).collect()]
    plain = [" ".join(f"{a}{i}" for i in range(400)) for a in "abcdef"]
    rows = some + some[:3] + [(some[0][0], plain[0], "en", None), (None, plain[0], None, "x"), (None, plain[1], "en", None), (None, plain[1], "en", None), (None, None, None, None), (7001, None, None, "y"), (7002, "", "de", "y"), (7003, " \n ", "de", "y")]
    rows += [(7004, plain[2], "en", "z"), (7004, plain[2] + " tail", "en", "z"), (7005, plain[2] + " tail one", "en", "z"), (7004, plain[3], "en", "z"), (7006, f"{plain[4]}, Item0 " + " ".join(f"item{i}" for i in range(1, 14)) + " end.\n", "en", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in CLASHING} | {"m": F.create_map(F.lit("a"), F.lit(1)), "copy": F.lit(5)})
    root = tmp_path_factory.mktemp("odd")
    items = [(1, " ".join(f"item{i}" for i in range(14))), (2, None), (3, some[5][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return df.cache(), str(root), items


def cases(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_odd_rows(spark, odd):
    docs, root, items = odd
    before = docs.collect()
    rows = cases(before)

    out = STAGES["quality rules"](spark, docs, root)
    assert out.columns == docs.columns
    kept = cases(quality_rules.judge(docs).join(docs.select("doc_id", "text", F.xxhash64("text").alias("th")).distinct().withColumnRenamed("doc_id", "i"), "th").where("kept and doc_id <=> i").select("doc_id", "text").collect())
    assert cases(out.collect()) == {k: n for k, n in rows.items() if k in kept}

    out = STAGES["near duplicates"](spark, docs, root)
    assert out.columns == docs.columns
    got = cases(out.collect())
    numbered = list(rows)
    root_of = {n: c for n, (_, c) in brute.components([(n, t) for n, (_, t) in enumerate(numbered)]).items()}
    want = Counter()
    for group in set(root_of.values()):
        members = [numbered[n] for n, c in root_of.items() if c == group]
        if not brute.shingles(members[0][1]):
            want[members[0]] = rows[members[0]]
            continue
        ids = [i for i, _ in members if i is not None]
        found = [m for m in members if got.get(m)]
        assert len(found) == 1 and got[found[0]] == 1 and found[0][0] == (min(ids) if ids else None)
        want[found[0]] = 1
    assert got == want and got[7004, before[-2].text] == 1

    out = STAGES["substring dedup"](spark, docs, root).collect()
    assert len(out) == len(before)
    ided = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
    first = {}
    for i, t in ided:
        w = brute.plain(t)
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(i, first.get(k, i))
    want = Counter()
    for i, t in rows.elements():
        w = brute.plain(t)
        gone = set() if i is None else {p for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for p in range(j, j + 13)}
        want[i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t] += 1
    assert cases(out) == want

    out = STAGES["benchmark decontamination"](spark, docs, root)
    assert out.columns == docs.columns
    want = Counter()
    for i, t in rows.elements():
        left = without_hits(t, items) if t else t
        if left is not None or t is None:
            want[i, left] += 1
    assert cases(out.collect()) == want and any(t and t.endswith("e399 end.\n") for _, t in want) and sum(want.values()) < len(before)

    out = STAGES["source mix"](spark, docs, root)
    assert out.columns == [*docs.columns, "copy_"]
    times = cases(out.collect())
    assert set(times) <= set(rows) and all(n <= 2 * rows[k] for k, n in times.items()) and all(times[k] == rows[k] for k in rows if not brute.plain(k[1]))


def test_empty_tables(spark, odd):
    docs, root, _ = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), root)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns, name
