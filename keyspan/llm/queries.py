"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, license_scan, quality_model, quality_rules, shingle_join, source_mix, substring_dedup, token_counts, url_filter, warc


def table(spark, sf_dir, name, *columns):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def op1_shingle_join(spark, sf_dir):
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op3_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_substring_dedup(spark, sf_dir):
    rows = substring_dedup.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)
    return rows.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op6_source_mix(spark, sf_dir):
    mixed = source_mix.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_warc_revisits(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_quality_model(spark, sf_dir):
    return quality_model.score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_decontaminate(spark, sf_dir):
    rows = decontaminate.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_shingle_join, op2_url_filter, op3_quality_rules, op4_token_counts, op5_substring_dedup,
        op6_source_mix, op7_warc_revisits, op8_quality_model, op9_license_scan, op10_decontaminate,
    )
}

BASE32 = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || hex[{5 * i + 1}:{5 * i + 5}])::INT >> {s}) & 31) + 1]" for i in range(8) for s in (15, 10, 5, 0))

ORACLE_SQL = {
    "op1_shingle_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id""",
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) < 13 THEN [] ELSE range(1, len(w) - 11) END) AS p, w FROM w),
h AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS win FROM g),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS low FROM h),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM m WHERE low < doc_id),
y AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN y USING (doc_id)""",
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, least(len(w), 13) AS k, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM k),
ks AS (SELECT DISTINCT k FROM bw),
dk AS (SELECT doc_id, w, k, unnest(CASE WHEN len(w) < k THEN [] ELSE range(1, len(w) - k + 2) END) AS p FROM d CROSS JOIN ks),
h AS (SELECT doc_id, p, dk.k, item_id FROM dk JOIN bw ON bw.k = dk.k AND bw.win = array_to_string(w[p:p + dk.k - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS i FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op6_source_mix": """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key
  FROM documents),
s AS (SELECT key, source, sum(size)::DOUBLE AS source_size FROM d GROUP BY key, source),
w AS (SELECT key, source_size, 2 * source_size AS most,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, (most / w, key)) AS level FROM l WHERE most > level * w),
g AS (SELECT key, source_size, CASE WHEN f.level IS NULL THEN most ELSE least(most, f.level * w) END AS target FROM l LEFT JOIN f ON true),
b AS (SELECT *, (target > source_size)::INT AS base, target - (target > source_size)::INT * source_size AS budget FROM g),
c AS (SELECT d.doc_id, d.size, d.h, b.*,
    sum(d.size) OVER (PARTITION BY d.key ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.key, d.h) AS own
  FROM d JOIN b ON d.key = b.key)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
  (size * (base + (upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)))::INT))::BIGINT AS taken
FROM c""",
    "op7_warc_revisits": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, {BASE32} AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM m""",
}
