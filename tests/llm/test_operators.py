"""Operators against plain versions, on a driver table and on texts with every awkward case."""

import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyspan.llm import decontaminate, license_scan, quality_model, quality_rules, queries, shingle_join, source_mix, substring_dedup, textscan, token_counts, url_filter, warc
from tests.llm import brute

WORDS = [f"w{i}" for i in range(40)]
LONG = " ".join(f"x{i}" for i in range(700))
AWKWARD = [
    None, "", " \n\t ", "one", "Two Words", "two words", "a b c d", "A B C D e", " ".join(WORDS), " ".join(WORDS).upper(), " ".join([*WORDS[:39], "other"]),
    " ".join(WORDS[:20]) + "\n" + " ".join(WORDS[:20]), "x\x0by\x0cz\x1cq\x85r s", "###\n###\n\nno | yes\nno | yes\n", LONG, LONG + " tail", "pre " + LONG, "é É ß ẞ 日本 語" * 20, "the mit " * 60,
    "Released under the MIT License. Also under the mit license; Apache License, Version 2.0 and CC BY-NC 4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files",
    " ".join(WORDS), LONG,
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"count": F.lit(1), "id": F.lit("x"), "token": F.lit(2.0), "key": F.lit(None).cast("int")})


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["awkward", "documents"])
def test_statistics_and_phrases(name, request):
    df = request.getfixturevalue(name)
    texts = dict(pairs(df))
    for r in quality_rules.judge(df).collect():
        want = brute.statistics(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    for r in license_scan.scan_licenses(df).collect():
        want = brute.phrases(texts[r.doc_id], license_scan.PHRASES)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@pytest.mark.parametrize("name", ["awkward", "documents"])
def test_joins_and_repeats(name, request):
    df = request.getfixturevalue(name)
    rows = pairs(df)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.jaccard_components(df).collect()}
    assert got == brute.components(rows)
    got = {r.doc: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(df, digest=True).collect()}
    assert got == brute.without_repeats(rows)


def test_license_labels_against_plain_loops(spark, awkward, documents):
    """labels and score of spans, by diagonals listed one by one."""
    filler = "lorem ipsum dolor sit amet consectetur"
    texts = [f"{filler} {t} {filler}" for _, t in license_scan.TEMPLATES]
    cut = [t.split() for _, t in license_scan.TEMPLATES]
    texts += [" ".join(w[: int(len(w) * 0.7)]) for w in cut] + [" ".join(w[: int(len(w) * 0.4)]) for w in cut] + [" ".join([*w[:6], "really", *w[6:]]) for w in cut] + [" ".join([*w[:7], *["far"] * 30, *w[7:]]) for w in cut]
    texts += [" ".join(a + b) for a, b in zip(cut, cut[1:], strict=False)] + [" ".join(w[:5] + w[7:]) for w in cut]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(awkward.selectExpr("doc_id + 1000 as doc_id", "text")).unionByName(documents.selectExpr("doc_id + 10000 as doc_id", "text"))
    rows = dict(pairs(df))
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(df).collect()}
    found = set()
    for i, t in rows.items():
        labels, score = brute.licenses(t, license_scan)
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-9, (i, t, got[i], labels, score)
        found |= set(labels.split(","))
    assert found >= {label for label, _ in license_scan.TEMPLATES}


def test_hot_prefixes_and_maximal_repeats(spark, awkward):
    """Prefixes over the group size are lengthened to whole windows: the same result."""
    rows = pairs(awkward)
    got = {r.doc: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(awkward, digest=True, group=1).collect()}
    assert got == brute.without_repeats(rows)
    texts = [" ".join(f"{a}{i}" for i in range(60)) for a in "pqr"]
    x, y, z = (t.split() for t in texts)
    many = [(i, " ".join([f"s{i}", *x[5:45], f"t{i}", *(y[10:40] if i % 2 else z[:12])])) for i in range(40)]
    more = many + [(1000 + i, " ".join([f"u{i}", *y[20:50], f"v{i % 70}"])) for i in range(200)]
    many_rows = spark.createDataFrame(more, "doc_id long, text string")
    assert {r.doc: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(many_rows, digest=True, group=4).collect()} == brute.without_repeats(more)  # nodes beyond and within the hot limit
    df = spark.createDataFrame(many, "doc_id long, text string")
    want = brute.without_repeats(many)
    for group in (4, 1 << 14):
        assert {r.doc: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(df, digest=True, group=group).collect()} == want
    spans = sorted((r.doc, r.start, r.words) for r in substring_dedup.maximal_repeats(df).collect())
    assert spans == sorted([(i, 1, 40) for i in range(1, 40)] + [(i, 42, 30) for i in range(3, 40, 2)])


def test_hot_windows_leave_combined(spark, monkeypatch):
    """A group of near copies leaves the scans as different windows a task and as runs, not as a row for each window."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([f"s{i}", *words[:60], f"t{i}", *words[60:]])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    made = {}

    def counted(self, func, schema, *more, f=type(df).mapInArrow):
        n = made.setdefault(schema, spark.sparkContext.accumulator(0))

        def scan(batches):
            for b in func(batches):
                n.add(b.num_rows)
                yield b

        return f(self, scan, schema, *more)

    monkeypatch.setattr(type(df), "mapInArrow", counted)
    want = brute.without_repeats(rows)
    windows = 400 * (48 + 28)
    for held in (100, 1 << 18):
        monkeypatch.setattr(substring_dedup, "HELD", held)
        made.clear()
        assert {r.doc: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(df, digest=True, group=4).collect()} == want
        hot = {k: n.value for k, n in made.items() if "w1 long" in k}
        assert hot and (held == 100 or max(hot.values()) < windows / 5), hot


def test_unequal_sets_with_one_id(spark, awkward, monkeypatch):
    """Sets that meet in the first id are told apart by the second."""
    short = lambda d, v, n, f=shingle_join.set_ids: (lambda size, a, b: (size, a % np.uint64(3), b))(*f(d, v, n))
    rows = [(i, t) for i, t in pairs(awkward) if i % 2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(shingle_join, "set_ids", short)
    docs = df.select(F.col("doc_id").alias("doc"), "text", F.xxhash64("text").alias("th"))
    table, nodes, renamed = shingle_join.nodes_of(shingle_join.written(spark.createDataFrame(
        [(i, 0, n, s1, s2, b"", b"") for i, (n, s1, s2) in enumerate([(5, 1, 10), (5, 1, 11), (5, 1, 11), (6, 2, 3), (0, 1, 1), (7, 1, 12)])], docs.selectExpr("doc", "th", "doc as n", "doc as s1", "doc as s2", "cast('' as binary) as bits", "cast('' as binary) as small").schema), "sets"))
    ids = {r.doc: r.s1 for r in table.collect()}
    assert ids[0] == 1 and ids[1] == ids[2] not in (1, 2) and ids[5] not in (1, 2, ids[1]) and len(renamed) == 2 and nodes.count() == 4


def test_links_are_verified_from_their_own_texts(spark, tmp_path, monkeypatch):
    """Only texts of the pairs' documents are put to words, once; repeated rows, null ids and ids with several texts among them."""
    near = [" ".join(WORDS[:39] + [f"tail{i}"]) for i in range(6)]
    far = [" ".join(f"far{i}x{j}" for j in range(12)) for i in range(40)]
    rows = [(5, near[0]), (5, near[0]), (5, near[1]), (5, far[0]), (None, near[2]), (None, near[2]), (None, far[1]), (7, near[3]), (8, near[3]), (None, None), (9, "")] + [(100 + i, t) for i, t in enumerate(far)]
    source = spark.createDataFrame(rows, "doc long, text string").withColumn("th", F.xxhash64("text")).repartition(3)

    def counted(column, f=textscan.scan_words, **how):
        (tmp_path / uuid.uuid4().hex).write_text(str(len(column)))
        yield from f(column, **how)

    table, nodes, renamed = shingle_join.nodes_of(shingle_join.written(shingle_join.sets_table(source), "sets"))
    ids = [r.s1 for r in table.where(F.col("n") == 36).select("s1").distinct().collect()]
    other = table.where(F.col("n") == 8).select("s1").first().s1
    own = {r.doc for r in nodes.where(F.col("s1").isin([*ids, other])).collect()}
    pairs = shingle_join.written(spark.createDataFrame([(max(a, b), min(a, b)) for i, a in enumerate([*ids, other]) for b in ids[:i]], "a long, b long"), "pairs")
    monkeypatch.setattr(shingle_join, "scan_words", counted)
    links = shingle_join.verified(source, pairs, None, nodes, renamed)
    assert len(ids) == 4 and {(r.a, r.b) for r in links.collect()} == {(max(a, b), min(a, b)) for i, a in enumerate(ids) for b in ids[:i]} and links.count() == 6
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == sum(d in own for d, _ in rows) < len(rows) / 2


def test_sets_against_plain_loops():
    texts = pa.array([*AWKWARD, "", None, "a", "b a", "a b c d", "a b c d e", "a " * 30])
    for w in textscan.scan_words(texts, lower=True):
        d, v = shingle_join.chunk_sets(w)
        assert [np.sum(d == i) for i in range(w.hi - w.lo)] == [len(brute.shingles(t.as_py())) for t in texts[w.lo : w.hi]]
        assert (np.lexsort((v, d)) == np.arange(len(v))).all()
        size, late = np.bincount(d, minlength=w.hi - w.lo), v % np.uint64(3) == 0
        start, order, want = np.cumsum(size) - size, np.lexsort((late, d)), np.empty(len(v), np.int64)
        want[order] = np.arange(len(v)) - start[d]
        assert (shingle_join.prefix_places(size, late) == want).all()
        assert (shingle_join.is_in(v, np.unique(v[late])) == late).all() and not shingle_join.is_in(v, None).any() and not shingle_join.is_in(v, v[:0]).any()


def test_license_texts_keep_apart(spark):
    cc = "This work is licensed under a Creative Commons Attribution{} International License."
    cases = [(t, label) for label, t in license_scan.TEMPLATES] + [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Released under the GNU General Public License, version 2 or later", "gpl"), ("licensed under the GNU GPL, version 3", "gpl"),
        ("licensed under the GNU Lesser General Public License, version 3", "lgpl"), ("licensed under the GNU Affero General Public License, version 3", ""), ("licensed under the GNU LGPL version 3", "lgpl"),
        (cc.format(" 4.0"), "cc-by"), (cc.format("-ShareAlike 4.0"), "cc-by-sa"), (cc.format("-NonCommercial 4.0"), "cc-by-nc"), (cc.format("-NoDerivatives 4.0"), ""), (cc.format("-NonCommercial-ShareAlike 4.0"), ""), (cc.format(" 3.0"), "cc-by"),
        (cc.format(" 4.0") + " And another part: " + cc.format("-ShareAlike 4.0"), "cc-by,cc-by-sa"), (cc.format(" 4.0").replace("is", "is hereby"), "cc-by"),
        (license_scan.TEMPLATES[1][1].replace("apache", "educational community"), ""),
    ]
    df = spark.createDataFrame([(i, f"w {t} w") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(df).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(cases)] == cases


def test_contamination(spark, documents, awkward):
    items = [(1, " ".join(WORDS[5:25])), (2, "mit license"), (3, None), (10, LONG[:300]), (11, "zzz yyy"), (2, "mit license")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(awkward, bench).collect()}
    assert got == brute.contamination(pairs(awkward), items)
    assert decontaminate.contamination(awkward, bench.limit(0)).where("n_hit > 0").count() == 0


def test_token_counts(awkward, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = documents.sparkSession.createDataFrame([(-1, "a <|endoftext|> b<|endoftext|>"), (-2, "  x\n\n  don't 12345 日本語   "), (-3, "z" * 5000 + " " * 3000)], "doc_id long, text string")
    df = documents.select("doc_id", "text").limit(50).unionByName(awkward.select("doc_id", "text")).unionByName(extra)
    texts = [(r.doc_id, r.text or "") for r in df.collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, path).collect())
    n = [len(library.encode(t, add_special_tokens=False).ids) for _, t in texts]
    assert got == sorted((i, len(t.encode()), k, k > 1024) for (i, t), k in zip(texts, n, strict=True))
    counter = token_counts.counter(path)
    assert len(counter.whole) > 40_000
    blocks = [range(0, token_counts.NEAR)] + [range(a, a + 1024) for a in (0x500, 0x2000, 0x3000, 0x4C00, 0xA400, 0xFE00, 0x10400, 0x1D400, 0x1F400, 0x1FB00, 0x2A000, 0xE0000, 0x10FC00)]
    for block in blocks:  # the classes are those of the library's splitter
        x = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}{chr(c)}  {chr(c)} " for c in block)
        want = [b - a for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(x)]
        assert [len(p) for p in (counter.far if block.stop > token_counts.NEAR else counter.near).findall(x)] == want
    rng = np.random.default_rng(0)
    pool = [*map(chr, range(0x20, 0x250)), *"\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u3000\u2003\x85\u200d\ufe0f", *map(chr, range(0x3040, 0x3100)), *map(chr, range(0x4E00, 0x4F00)), *map(chr, range(0x1F600, 0x1F650)), *" '12\n.st" * 30]
    for _ in range(500):
        x = "".join(rng.choice(pool, rng.integers(0, 80)))
        assert counter.count(x) == len(library.encode(x, add_special_tokens=False).ids), x


def test_unproven_strings_are_merged(tmp_path):
    """A vocabulary string that its own merges can't reach isn't a whole token."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"]["qzxj"] = max(spec["model"]["vocab"].values()) + 10
    path = str(tmp_path / "v.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    counter, library = token_counts.WholeTokenCounter(path), Tokenizer.from_file(path)
    assert "qzxj" not in counter.whole and "the" in counter.whole
    assert counter.count("qzxj the") == len(library.encode("qzxj the").ids) > 2


def test_rejected_documents_are_mostly_bad(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed")
    good = r.where("quality = 1").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    assert good > 0.99


def test_junk_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed and quality = 0").agg(F.count("*"), F.avg(F.col("kept").cast("double"))).first()
    assert r[0] > 20 and r[1] < 0.1


def plain_estimate(x):
    """(n, mean, covariance, scale) by plain concentration steps."""
    floor = np.diag(np.square(quality_rules.FLOORS))
    rank = lambda d, share: np.sort(d, axis=0)[max(int(np.ceil(share * len(d))) - 1, 0)]
    m, c = rank(x, 0.5), np.diag(((rank(x, 0.75) - rank(x, 0.25)) / 1.349) ** 2)
    dist = lambda: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + floor), x - m)
    for _ in range(quality_rules.STEPS):
        d = dist()
        core = x[d <= rank(d, 0.75)]
        m, c = core.mean(0), np.cov(core.T, bias=True)
    return len(x), m, c, max(rank(dist(), 0.5) / quality_rules.MEDIAN, 1.0)


def test_verdicts_against_numpy(spark, tmp_path):
    """kept, end to end: statistics, vectors, estimates of three levels drawn together, distance and cut."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(60 + i)), None if i % 2 else "en", None if i % 3 else "solo") for i in range(1, 9)], "doc_id long, text string, lang string, source string")
    docs = docs.select(*extra.columns).unionByName(extra)
    rows = [(r, brute.statistics(r.text)) for r in docs.collect()]

    def vector(s):
        n, chars = max(s["n_words"], 1), max(s["word_chars"], 1)
        return [np.log(chars / n), (s["n_symbols"] / chars) ** 0.5, min(1, 5 * s["n_dup_lines"] / n) ** 0.5, (s["n_repeat_words"] / n) ** 0.5, np.log(n)]

    passed = [s["n_words"] >= 50 and 100 * s["n_repeat_words"] <= 50 * s["n_words"] for _, s in rows]
    x = np.array([vector(s) for _, s in rows])
    at = {}
    for key in {k for r, _ in rows for k in ((r.lang, r.source), (r.lang,), ())}:
        of = np.array([p and (r.lang, r.source)[: len(key)] == key for (r, _), p in zip(rows, passed, strict=True)])
        at[key] = plain_estimate(x[of]) if of.any() else None

    def blend(own, wide):
        if own is None or wide is None:
            return own or wide
        free = max(own[0] - 10, 0)
        w = free / (free + quality_rules.PRIOR)
        return (1 / (w * w / own[0] + (1 - w) ** 2 / wide[0]), *[w * a + (1 - w) * b for a, b in zip(own[1:], wide[1:], strict=True)])

    def quantile(v, z=4.7534, p=5):
        """The F quantile with p and v degrees of freedom whose cube root's normal form is z, by bisection."""
        a, b, low, high = 2 / (9 * p), 2 / (9 * v), 0.0, 100.0
        for _ in range(200):
            x = (low + high) / 2
            low, high = (x, high) if ((1 - b) * x - (1 - a)) / (b * x * x + a) ** 0.5 < z else (low, x)
        return low**3

    floor = np.diag(np.square(quality_rules.FLOORS))
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    near = 0
    for (r, _), p, v in zip(rows, passed, x, strict=True):
        n, m, c, scale = blend(at[r.lang, r.source], blend(at[(r.lang,)], at[()]))
        cut = quality_rules.CUT * quantile(0.75 * n - 4) / quantile(1e12)
        d = (v - m) @ np.linalg.inv(c + floor) @ (v - m) / scale
        assert np.isclose(got[r.doc_id].distance, d, rtol=1e-3), (r.doc_id, got[r.doc_id].distance, d)
        near += abs(d - cut) < 0.01
        if abs(d - cut) >= 0.01:
            assert got[r.doc_id].kept == (p and d <= cut)
    assert near <= 2 and sum(not got[r.doc_id].kept and p for (r, _), p in zip(rows, passed, strict=True)) > 5


def test_outliers_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 5)) * [0.3, 0.4, 0.4, 0.4, 0.8] + [1.6, 1, 1, 1, 6]
    x[:40] += 9
    rows = spark.createDataFrame([("k", *map(float, r)) for r in x], "key string, v1 double, v2 double, v3 double, v4 double, v5 double")
    est = quality_rules.robust_estimates(rows, 1)
    got = np.array([r.d for r in rows.withColumn("i", F.monotonically_increasing_id()).join(est, "key").withColumn("d", quality_rules.distance()).orderBy("i").collect()])
    far = (got > quality_rules.CUT).sum()
    assert far == 40
    # plain concentration steps
    floor = np.diag(np.square(quality_rules.FLOORS))
    q = np.percentile(x, [25, 50, 75], axis=0, method="inverted_cdf")
    m, c = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floor
    dist = lambda: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(quality_rules.STEPS):
        d = dist()
        core = x[d <= np.sort(d)[int(np.ceil(0.75 * len(d))) - 1]]
        m, c = core.mean(0), np.cov(core.T, bias=True) + floor
    d = dist()
    d /= max(np.sort(d)[(len(d) + 1) // 2 - 1] / quality_rules.MEDIAN, 1)
    assert np.allclose(np.sort(d), np.sort(got), rtol=1e-6)


def test_urls(spark):
    urls = ["http://EXAMPLE.com/en/x?q=1", "https://www.example.com/en/", "http://a.b.net/es/1", "http://net/fr/", "ftp://x.org/en#a", "nohost", None, "http://example.com", "http://example.com?x", "http://comx/", "a://b://c/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == ("net/fr/", "block")
    assert got[4][:3] == ("x.org", "/en", None) and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None)
    assert got[7][:3] == ("example.com", "", None) and got[8][:3] == ("example.com", "", None) and got[9][2] is None and got[10][:2] == ("b:", "//c/")
    assert all(v[3] in ("allow", "block") for v in got.values())


def test_urls_against_sql(spark):
    """Host, path and rule of every url by SQL."""
    import duckdb

    rules = ", ".join(f"('{t}', '{v}')" for t, v in url_filter.RULES)
    sql = f"""WITH r(rule, verdict) AS (VALUES {rules}),
    p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM read_parquet('/root/testdata/sf0.01/pages.parquet')),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id)
    SELECT h.page_id, host, path, rule, verdict FROM h LEFT JOIN m USING (page_id)"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert got.keys() == want.keys()
    for i, (host, path, rule, verdict) in want.items():
        assert got[i][:3] == (host, path, rule) and (rule is None and got[i][3] in ("allow", "block") or got[i][3] == verdict)


def test_url_model_on_unseen_hosts(spark):
    """Ruled urls of hosts that took no part in the fit get their rule's verdict mostly; unruled verdicts differ."""
    from zlib import crc32

    import pyarrow as pa

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = url_filter.filter_urls(pages)
    assert {r.verdict for r in rows.where("rule is null").select("verdict").distinct().collect()} == {"allow", "block"}
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(url_filter.BUCKETS)).cast("int")
    rows = rows.join(pages.select("page_id", "url"), "page_id").withColumns({"suffix": bucket(F.substring_index("host", ".", -2)), "segment": bucket(F.regexp_extract("path", "^/([^/]*)", 1))})
    t = rows.where("rule is not null").toArrow()
    blocked = np.array([v == "block" for v in t["verdict"].to_pylist()])
    unseen = np.array([crc32(h.encode()) % 3 == 0 for h in t["host"].to_pylist()])
    model = url_filter.fit_filter(t.filter(pa.array(~unseen)), blocked[~unseen], url_filter.suffix_statistics(rows))
    rest = t.filter(pa.array(unseen)).combine_chunks()
    p = model.score(*[rest[c].combine_chunks() for c in ("url", "host", "path")], rest["suffix"].to_numpy(), rest["segment"].to_numpy())
    right = (p >= model.cut) == blocked[unseen]
    assert (right[blocked[unseen]].mean() + right[~blocked[unseen]].mean()) / 2 > 0.8


def test_url_features_against_plain_counts():
    import pyarrow as pa

    urls = ["https://a-1.example.com/en/12/x-y.html?p=1&q=22#f", None, "", "x"]
    hosts, paths = ["a-1.example.com", "", "", ""], ["/en/12/x-y.html", "", "", ""]
    x = url_filter.features(pa.array(urls), pa.array(hosts), pa.array(paths), np.zeros(4, int), np.array([[0.5, 1, 2]]), np.full(4, 0.25))
    for row, u, h, p in zip(x, urls, hosts, paths, strict=True):
        u = u or ""
        bits = lambda t: -sum(t.count(c) / len(t) * np.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0
        share = lambda t: sum(c.isdigit() for c in t) / max(len(t), 1)
        want = [len(u), len(h), len(p), len(u) - len(h) - len(p), p.count("/"), share(u), share(h), bits(u), bits(h), u.count("=") + u.count("&"), h.count("."), h.count("-"), p.count("-"), p.count("."), u.count("#"), 0.5, 1, 2, 0.25]
        assert np.allclose(row, want)


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = url_filter.fit_boosted(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.93


def test_warc_round_trip(spark):
    import base64
    import hashlib

    html = ["<p>a</p>", "", None, "<p>a</p>", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n", "é" * 3000, "<p>a</p>", ""]
    df = spark.createDataFrame([(i, f"http://x/ {i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_pages(df).collect()}
    first = {}
    for i, h in enumerate(html):
        b = (h or "").encode()
        low = first.setdefault(b, i)
        assert got[i].payload_bytes == len(b) and got[i].payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (got[i].record_type, got[i].refers_to) == (("revisit", low) if low < i else ("response", None))
    few = {r.page_id: r.record_type for r in warc.archive_pages(df, min_bytes=1).collect()}
    assert few[1] == few[2] == few[7] == "response" and few[3] == "revisit"


def test_warc_repeated_and_null_ids(spark):
    """Rows out are rows in, each judged by its own payload; the same as the registered SQL."""
    import duckdb

    cases = [
        [(1, "A"), (2, "A"), (2, "B"), (None, "A")], [(1, "A"), (0, "B"), (2, "A"), (2, "B")], [(None, "A"), (None, "A"), (3, "C")], [(5, ""), (4, None), (4, ""), (None, None)],
        [(1, "A"), (1, "A"), (1, "B"), (2, "B"), (7, "A")], [(i % 9, "hot") for i in range(600)] + [(1, "x")],
    ]
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for kind in ("long", "smallint"):
        for rows in cases if kind == "long" else cases[:2]:
            df = spark.createDataFrame([(i, f"u{n}", h) for n, (i, h) in enumerate(rows)], "page_id long, url string, html string").withColumn("page_id", F.col("page_id").cast(kind))
            got = [tuple(r) for r in warc.archive_pages(df).select(*columns).collect()]
            con = duckdb.connect()
            con.execute("create table pages (page_id bigint, html varchar)")
            con.executemany("insert into pages values (?, ?)", rows)
            want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL['op7_warc_revisits']})").fetchall()
            assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)


def test_mix(spark, documents):
    rows = source_mix.mix(documents).collect()
    size = {}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        size.setdefault(r.source_size, []).append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * total) < 0.05 * total
    again = {r.doc_id: r.taken for r in source_mix.mix(documents.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_quality_model_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_model.score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality").toPandas()
    s, y = rows["score"].to_numpy(), rows["quality"].to_numpy()
    rank = s.argsort().argsort() + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9 and ((s >= 0.5) == y).mean() > 0.9


def test_quality_vectors_against_plain_loops(spark, awkward):
    """Context vectors, pooling and scores, word by word."""
    import re
    import zlib

    import pyarrow as pa
    from keyspan.llm import textscan

    def bucket(word):
        (w,) = textscan.scan_words(pa.array([word]), lower=True, marks=True)
        return int(quality_model.buckets(w.hashes())[0])

    def words(text):
        return re.findall(r"[!-/:-@\[-`{-~]+|[^\x20\x09-\x0D!-/:-@\[-`{-~]+", brute.low(text))

    rows = pairs(awkward)
    C, own = quality_model.CONTEXT, quality_model.OWN
    place, sign = quality_model.index_vectors(C, 1)
    sums = np.zeros((quality_model.BUCKETS, C))
    known = {}
    texts = []
    for _, t in rows:
        at = [known.setdefault(w, bucket(w)) for w in words(t)]
        texts.append(at)
        for i, x in enumerate(at):
            for j in range(max(0, i - quality_model.REACH), min(len(at), i + quality_model.REACH + 1)):
                if i != j:
                    for k in (0, 1):
                        sums[x, place[at[j], k]] += sign[at[j], k]
    context = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)
    got = quality_model.context_vectors(awkward.select("text"))
    assert np.allclose(got, context, atol=1e-6)
    place, sign = quality_model.index_vectors(own, 2)
    want = np.zeros((len(rows), C + own + 1))
    for d, at in enumerate(texts):
        for x in at:
            want[d, :C] += context[x] / len(at)
            for k in (0, 1):
                want[d, C + place[x, k]] += sign[x, k] / len(at)
        want[d, -1] = np.log1p(len(at))
    x = np.concatenate([v for _, _, v in quality_model.pooled(pa.array([t for _, t in rows]), got)])
    assert np.allclose(x, want, atol=1e-5)
    net = quality_model.Network(np.zeros(3), np.ones(3), np.array([[1.0, -1], [0, 2], [0.5, 0]]), np.array([0.1, -0.2]), np.array([1.0, -2]), 0.3, 2.0)
    v = np.array([[1.0, 2, 3]])
    hidden = [max(1 * 1 + 2 * 0 + 3 * 0.5 + 0.1, 0), max(-1 + 4 + 0 - 0.2, 0)]
    assert np.isclose(net.score(v)[0], 1 / (1 + np.exp(-(hidden[0] - 2 * hidden[1] + 0.3) / 2)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(rows))], "doc_id long, quality int")
    scored = {r.doc_id: r for r in quality_model.score_quality(awkward, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in scored.items())


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert quality_rules.judge(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert shingle_join.jaccard_components(none).count() == 0
    assert substring_dedup.without_repeats(none).count() == 0
    assert source_mix.mix(none).count() == 0
    assert decontaminate.contamination(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_model.score_quality(none, labels).count() == 0
    assert {r.score for r in quality_model.score_quality(documents, labels.limit(0)).collect()} == {0.5}
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    import public_tokenizers

    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert url_filter.filter_urls(pages).count() == 0 and warc.archive_pages(pages).count() == 0


def test_repeated_rows(spark, awkward):
    twice = awkward.unionByName(awkward)
    n = twice.count()
    assert quality_rules.judge(twice).count() == n
    assert license_scan.scan_licenses(twice).count() == n
    assert shingle_join.jaccard_components(twice).count() == n
    assert substring_dedup.without_repeats(twice).count() == n
    assert source_mix.mix(twice).count() == n
    bench = spark.createDataFrame([(1, " ".join(WORDS[5:25]))], "item_id long, text string")
    assert decontaminate.contamination(twice, bench).count() == n
    import public_tokenizers

    assert token_counts.count_tokens(twice, public_tokenizers.path("byte_bpe_50k.json")).count() == n
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(2, 1)], "doc_id long, quality int")
    scored = quality_model.score_quality(twice, labels)
    assert scored.count() == n and scored.distinct().count() == awkward.count()
    pages = twice.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.example.com/"), "doc_id").alias("url"), F.col("text").alias("html"), "count", "key")
    assert url_filter.filter_urls(pages).count() == n and warc.archive_pages(pages).count() == n


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(60)]
    for i in range(0, 60, 2):
        keep = rng.random(len(sets[i])) < rng.uniform(0.7, 1)
        sets.append(np.unique(np.r_[sets[i][keep], rng.integers(0, 2**63, 10).astype(np.uint64)]))
    docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    raws = shingle_join.signatures(docs, np.concatenate(sets), len(sets))
    size = np.array([len(s) for s in sets])
    i, j = shingle_join.SignatureTree(size, shingle_join.folded(raws, shingle_join.TREE_BITS), np.arange(len(sets))).pairs()
    keep = shingle_join.may_link(size, raws, i, j)
    i, j = i[keep], j[keep]
    found = {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert want and want <= found and len(found) < 300


def test_all_queries_have_columns(spark, sf_dir):
    assert len(queries.QUERIES) == 10
