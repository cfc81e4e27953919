"""Registered queries of the signal and text operators, each over whole driver tables, with DuckDB oracles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels, repair_text
from .functions.codes import CODE_OF, PLAUSIBLE
from .functions.vocabulary import CALL_PATTERN, KNOWN_CALLS, USUAL_REPORTS
from .functions.vocabulary import WORDS as KNOWN_WORDS
from .operators import binarize, keying, repair, scoring, series, spectral, timing
from .operators import recordings as whole
from .plans import contest, decode
from .sources import audio
from .streaming import channels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- text to keying and back -------------------------------------------------------------------------------------------

CODES = ", ".join(f"('{s}', '{c}')" for s, c in CODE_OF.items() if len(s) == 1 and s.isalnum())
KEYABLE = "upper(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 \\n]', '', 'g'), '[ \\n]+', ' ', 'g')))"


def char_sql(source: str, rec: str) -> str:
    return f"""c(ch, code) AS (VALUES {CODES}),
t AS (SELECT {rec} AS rec, {KEYABLE} AS t FROM {source}),
x AS (SELECT rec, t, p, t[p] AS ch FROM (SELECT rec, t, unnest(range(1, length(t) + 1)) AS p FROM t WHERE t <> '')),
chars AS (SELECT x.rec, x.p AS pos, t[p + 1] = ' ' AS word_end, p = length(t) AS text_end, code FROM x JOIN c ON x.ch = c.ch)"""


def keying_sql(source: str, rec: str, jitter: int) -> str:
    vary = f"(((rec * 31 + pos * 17 + elem * 7 + state * 5) % {2 * jitter + 1}) - {jitter})" if jitter else "0"
    return f"""{char_sql(source, rec)},
e AS (SELECT rec, pos, word_end, text_end, length(code) AS n, unnest(range(0, length(code))) AS elem, code FROM chars),
s AS (SELECT rec, pos, elem, 1 AS state, CASE WHEN code[elem + 1] = '-' THEN 3 ELSE 1 END AS units FROM e
  UNION ALL SELECT rec, pos, elem, 0, CASE WHEN elem < n - 1 THEN 1 WHEN text_end THEN 0 WHEN word_end THEN 7 ELSE 3 END FROM e),
k AS (SELECT rec, pos, elem, state, units, units * (100 + {vary}) * (60.0::DOUBLE / 100.0) AS dur_ms FROM s WHERE units > 0),
seg AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY pos, elem, state DESC) AS seg_no FROM k)"""


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("rec"), "text")


TURN = "conv_id * 1000 + turn"


@query(f"""WITH {char_sql("documents", "doc_id")},
w AS (SELECT rec, pos, code || CASE WHEN text_end THEN '' WHEN word_end THEN ' / ' ELSE ' ' END AS part FROM chars)
SELECT d.doc_id, coalesce(string_agg(part, '' ORDER BY pos), '') AS codes FROM documents d LEFT JOIN w ON w.rec = d.doc_id GROUP BY d.doc_id""")
def morse_encode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keying.encode_text(F.col("text")).alias("codes"))


@query(f"SELECT doc_id, {KEYABLE} AS text FROM documents")
def morse_roundtrip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keying.decode_codes(keying.encode_text(F.col("text"))).alias("text"))


@query(f"WITH {keying_sql('conversations', TURN, 10)} SELECT rec, pos, elem, state, units, round(dur_ms, 6) AS dur_ms FROM k")
def keying_durations(spark, sf_dir):
    return rounded(keying.keying(turns(spark, sf_dir), "rec", "text", jitter=10), "dur_ms").select("rec", "pos", "elem", "state", "units", "dur_ms")


@query(f"SELECT {TURN} AS rec, {KEYABLE} AS text FROM conversations WHERE {KEYABLE} <> ''")
def keyed_roundtrip(spark, sf_dir):
    segs = keying.label_elements(keying.keying(turns(spark, sf_dir), "rec", "text", jitter=10), 60.0)
    return keying.assemble(segs, ["pos", "elem"])


@query(f"""WITH {keying_sql('documents', 'doc_id', 0)}
SELECT source, count(DISTINCT rec)::BIGINT AS recordings, round(sum(dur_ms) / 1000, 3) AS seconds, round(sum(units)::DOUBLE / 50 / (sum(dur_ms) / 60000), 6) AS wpm
FROM k JOIN documents d ON d.doc_id = k.rec GROUP BY source""")
def wpm_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    k = keying.keying(docs.select("doc_id", "text"), "doc_id", "text")
    per = k.groupBy("rec").agg(F.sum("dur_ms").alias("ms"), F.sum("units").alias("units"))
    joined = per.join(docs.select("doc_id", "source"), F.col("rec") == F.col("doc_id"))
    return joined.groupBy("source").agg(F.countDistinct("rec").alias("recordings"), F.round(F.sum("ms") / 1000, 3).alias("seconds"), F.round(F.sum("units").cast("double") / 50 / (F.sum("ms") / 60000), 6).alias("wpm"))


# --- series ------------------------------------------------------------------------------------------------------------

EVENTS = "s AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value::DOUBLE AS v FROM events)"


def samples(spark, sf_dir):
    return series.series(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


def ma(x: str, m: int) -> str:
    return f"(sum({x}) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN {m // 2} PRECEDING AND {(m - 1) // 2} FOLLOWING) / {m})"


def norm(x: str) -> str:
    return f"CASE WHEN max({x}) OVER (PARTITION BY rec) > 0 THEN {x} / max({x}) OVER (PARTITION BY rec) ELSE {x} END"


def taps(x: str, weights: list[float]) -> str:
    m = len(weights)
    parts = []
    for k, w in enumerate(weights):
        step = (m - 1) // 2 - k
        near = f"lag({x}, {-step}, 0) OVER (PARTITION BY rec ORDER BY i)" if step < 0 else f"lead({x}, {step}, 0) OVER (PARTITION BY rec ORDER BY i)" if step else x
        parts.append(f"{w!r}::DOUBLE * {near}")
    return "(" + " + ".join(parts) + ")"


HANN5 = [x / sum(series.hann(5)) for x in series.hann(5)]
SQUARE = f"p AS (SELECT *, sqrt(greatest({ma('v * v', 8)}, 0)) AS p FROM s), env AS (SELECT rec, i, v, {norm('p')} AS env FROM p)"


@query(f"WITH {EVENTS} SELECT rec, i, round({ma('v', 5)}, 6) AS avg FROM s")
def moving_average(spark, sf_dir):
    return rounded(series.moving_average(samples(spark, sf_dir), 5), "avg").select("rec", "i", "avg")


@query(f"WITH {EVENTS} SELECT rec, i, round({taps('v', HANN5)}, 6) AS avg FROM s")
def hann_average(spark, sf_dir):
    return rounded(series.hann_average(samples(spark, sf_dir), 5), "avg").select("rec", "i", "avg")


@query(f"WITH {EVENTS} SELECT rec, i, round(CASE WHEN count(*) OVER (PARTITION BY rec) >= 5 THEN {taps('v', [0.15, 0.7, 0.15])} ELSE v END, 6) AS smooth FROM s")
def three_tap(spark, sf_dir):
    return rounded(series.three_tap(samples(spark, sf_dir)), "smooth").select("rec", "i", "smooth")


@query(f"WITH {EVENTS}, d AS (SELECT rec, i, coalesce(greatest(v - lag(v) OVER (PARTITION BY rec ORDER BY i), 0), 0) AS d FROM s) SELECT rec, i, round({norm('d')}, 6) AS up FROM d")
def positive_difference(spark, sf_dir):
    return rounded(series.positive_difference(samples(spark, sf_dir)), "up").select("rec", "i", "up")


@query(f"WITH {EVENTS} SELECT rec, i, round(v * cos(i * (2 * pi() * 440 / 8000)), 6) AS re, round(-v * sin(i * (2 * pi() * 440 / 8000)), 6) + 0 AS im FROM s")
def mix_iq(spark, sf_dir):
    return rounded(series.mixed_down(samples(spark, sf_dir), 440.0, 8000.0), "re", "im").select("rec", "i", "re", "im")


@query(f"WITH {EVENTS} SELECT rec, i, round(sum(v) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) / 7, 6) AS avg FROM s")
def causal_average(spark, sf_dir):
    df = samples(spark, sf_dir).withColumn("avg", series.mean_causal(F.col("v"), 7))
    return rounded(df, "avg").select("rec", "i", "avg")


@query(f"WITH {EVENTS} SELECT rec, (i / 4)::BIGINT AS i, v FROM s WHERE i % 4 = 0")
def decimate(spark, sf_dir):
    return series.decimate(samples(spark, sf_dir), 4).select("rec", "i", "v")


@query(f"WITH {EVENTS} SELECT rec, i * 3 + k AS i, v FROM s, range(3) r(k)")
def repeat_upsample(spark, sf_dir):
    return series.repeated(samples(spark, sf_dir), 3).select("rec", "i", "v")


@query(f"WITH {EVENTS}, {SQUARE} SELECT rec, i, round(env, 6) AS env FROM env")
def square_law_env(spark, sf_dir):
    return rounded(series.square_law(samples(spark, sf_dir), 8), "env").select("rec", "i", "env")


@query(f"WITH {EVENTS}, q AS (SELECT rec, i, sqrt({taps('sq', HANN5)}) AS p FROM (SELECT *, v * v AS sq FROM s)) SELECT rec, i, round({norm('p')}, 6) AS env FROM q")
def hann_rms_env(spark, sf_dir):
    return rounded(series.hann_rms(samples(spark, sf_dir), 5), "env").select("rec", "i", "env")


@query(f"""WITH {EVENTS}, {SQUARE}, w AS (SELECT *, {ma('v * v', 3)} AS w FROM env),
d AS (SELECT *, coalesce(greatest(w - lag(w) OVER (PARTITION BY rec ORDER BY i), 0), 0) AS d FROM w),
u AS (SELECT *, 0.75::DOUBLE * env + 0.25::DOUBLE * ({norm('d')}) AS b FROM d) SELECT rec, i, round({norm('b')}, 6) AS env FROM u""")
def onset_env(spark, sf_dir):
    return rounded(series.onset_enhanced(samples(spark, sf_dir), 8, 3), "env").select("rec", "i", "env")


@query(f"WITH {EVENTS}, q AS (SELECT rec, i, v / greatest({ma('v', 9)}, 0.000001) AS q FROM s) SELECT rec, i, round({norm('q')}, 6) AS env FROM q")
def local_norm(spark, sf_dir):
    return rounded(series.local_mean_normalised(samples(spark, sf_dir), 9), "env").select("rec", "i", "env")


@query(f"""WITH {EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM s),
b AS (SELECT rec, max(n) AS n, avg(v) AS m FROM n WHERE i // 8 < n // 8 GROUP BY rec, i // 8),
g AS (SELECT rec, CASE WHEN max(n) < 32 THEN 0 ELSE stddev_pop(m) / (avg(m) + 1e-8) END AS qsb FROM b GROUP BY rec)
SELECT r.rec, round(coalesce(g.qsb, 0), 6) AS qsb FROM (SELECT DISTINCT rec FROM s) r LEFT JOIN g USING (rec)""")
def qsb_score(spark, sf_dir):
    return rounded(series.fading_score(samples(spark, sf_dir), 8), "qsb")


@query("""WITH RECURSIVE e AS (SELECT vec_id, embedding AS x FROM embeddings),
r AS (SELECT vec_id, x, 1 AS k, 0.2::DOUBLE * x[1]::DOUBLE AS y FROM e UNION ALL SELECT vec_id, x, k + 1, 0.8::DOUBLE * y + 0.2::DOUBLE * x[k + 1]::DOUBLE FROM r WHERE k < len(x))
SELECT vec_id, round(y, 6) AS ema FROM r WHERE k = len(x)""")
def iir_ema(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(series.exponential_average(F.col("embedding"), 0.2), 6).alias("ema"))


VECTORS = "s AS (SELECT vec_id AS rec, i - 1 AS i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"


def blocks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


@query(f"""WITH {VECTORS}, q AS (SELECT *, v * cos(i * (2 * pi() * 700 / 8000)) AS re, -v * sin(i * (2 * pi() * 700 / 8000)) AS im FROM s),
m AS (SELECT rec, i, sqrt(pow(sum(re) OVER w / 16, 2) + pow(sum(im) OVER w / 16, 2)) AS m FROM q WINDOW w AS (PARTITION BY rec ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
SELECT rec, i, round(m / (max(m) OVER (PARTITION BY rec) + 1e-8), 6) AS env FROM m""")
def coherent_env(spark, sf_dir):
    return rounded(series.coherent_envelope(blocks(spark, sf_dir), 700.0, 8000.0, 16), "env").select("rec", "i", "env")


# --- thresholds, key states, runs -----------------------------------------------------------------------------------------

OTSU = """top AS (SELECT rec, max(env) AS top, count(*) AS n, sum(env) AS total FROM env GROUP BY rec),
h AS (SELECT rec, top, n, total, least(floor(env / ((top + 1e-8) / 128)), 127) AS bin, count(*) AS c FROM env JOIN top USING (rec) GROUP BY ALL),
cu AS (SELECT *, (bin + 0.5::DOUBLE) * ((top + 1e-8) / 128) AS centre, sum(c) OVER (PARTITION BY rec ORDER BY bin) AS wb,
  sum(c * ((bin + 0.5::DOUBLE) * ((top + 1e-8) / 128))) OVER (PARTITION BY rec ORDER BY bin) AS sb FROM h),
va AS (SELECT *, round(wb * (n - wb) * pow(sb / wb - (total - sb) / (n - wb), 2), 9) AS var FROM cu WHERE wb < n),
otsu AS (SELECT top.rec, coalesce(arg_max(centre, (var, -bin)), 0.3::DOUBLE * any_value(top.top)) AS thr FROM top LEFT JOIN va ON va.rec = top.rec GROUP BY top.rec)"""
AUTO = f"""{OTSU}, q AS (SELECT rec, quantile_cont(env, [0.1, 0.25, 0.5, 0.75, 0.9]) AS p, max(env) AS top FROM env GROUP BY rec),
thr AS (SELECT rec, CASE WHEN p[1] < 0.02 AND p[5] - p[3] > 0.3 THEN greatest((p[2] + p[4]) / 2, 0.15) WHEN p[5] - p[3] > 0.3 * top THEN p[3] + 0.3::DOUBLE * (p[5] - p[3]) ELSE otsu.thr END AS thr FROM q JOIN otsu USING (rec))"""
HARD = """d AS (SELECT env.*, thr, max(env) OVER (PARTITION BY rec) AS top FROM env JOIN thr USING (rec)),
st AS (SELECT rec, i, (env > thr)::INT AS a, (env > 0.35::DOUBLE * top)::INT AS b FROM d),
key AS (SELECT rec, i, CASE WHEN (avg(a) OVER w < 0.05 OR avg(a) OVER w > 0.97) AND avg(b) OVER w > 0.08 AND avg(b) OVER w < 0.92 THEN b ELSE a END AS state FROM st WINDOW w AS (PARTITION BY rec))"""
RUNS = """ch AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY rec ORDER BY i) THEN 0 ELSE 1 END AS c FROM key),
ru AS (SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY i) AS run FROM ch),
runs AS (SELECT rec, run, min(state) AS state, min(i) AS first, count(*) AS length FROM ru GROUP BY rec, run)"""


def envelope(spark, sf_dir):
    return series.square_law(samples(spark, sf_dir), 8).select("rec", "i", "env")


def keyed(spark, sf_dir):
    env = envelope(spark, sf_dir)
    return binarize.hard_keyed(env, binarize.auto_threshold(env)).select("rec", "i", "state")


@query(f"WITH {EVENTS}, {SQUARE}, {OTSU} SELECT rec, round(thr, 6) AS thr FROM otsu")
def otsu(spark, sf_dir):
    return rounded(binarize.otsu_threshold(envelope(spark, sf_dir)), "thr")


@query(f"WITH {EVENTS}, {SQUARE}, {AUTO} SELECT rec, round(thr, 6) AS thr FROM thr")
def auto_threshold(spark, sf_dir):
    return rounded(binarize.auto_threshold(envelope(spark, sf_dir)), "thr")


@query(f"WITH {EVENTS}, {SQUARE}, {AUTO}, {HARD} SELECT rec, i, state FROM key")
def hard_key(spark, sf_dir):
    return keyed(spark, sf_dir)


@query(f"""WITH {EVENTS}, {SQUARE}, {AUTO}, z AS (SELECT rec, i, CASE WHEN env > thr THEN 1 WHEN env < thr * 0.65::DOUBLE THEN 0 END AS z FROM env JOIN thr USING (rec))
SELECT rec, i, coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY rec ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS state FROM z""")
def schmitt_key(spark, sf_dir):
    env = envelope(spark, sf_dir)
    return binarize.schmitt_keyed(env, binarize.auto_threshold(env)).select("rec", "i", "state")


@query(f"""WITH {EVENTS}, {SQUARE}, q AS (SELECT rec, quantile_cont(env, 0.75) AS hi, quantile_cont(env, 0.25) AS lo FROM env GROUP BY rec),
z AS (SELECT rec, i, hi, lo, coalesce(last_value(CASE WHEN env > hi THEN 1 WHEN env < lo THEN 0 END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS s FROM env JOIN q USING (rec))
SELECT rec, i, CASE WHEN hi - lo >= 0.02 AND avg(s) OVER (PARTITION BY rec) BETWEEN 0.03 AND 0.97 THEN s END AS state FROM z""")
def percentile_key(spark, sf_dir):
    return binarize.percentile_keyed(envelope(spark, sf_dir)).select("rec", "i", "state")


@query(f"""WITH {EVENTS}, {SQUARE}, {AUTO}, {HARD}, {RUNS},
g AS (SELECT *, CASE WHEN length < 3 AND run > 1 THEN 0 ELSE length END + coalesce(lead(CASE WHEN length < 3 THEN length ELSE 0 END) OVER (PARTITION BY rec ORDER BY run), 0) AS total FROM runs)
SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY run) AS seg_no, state, round(total * 125.0, 6)::DOUBLE AS dur_ms FROM g WHERE total > 0""")
def rle_segments(spark, sf_dir):
    return rounded(binarize.segments(keyed(spark, sf_dir), 8.0, 3), "dur_ms")


@query(f"""WITH {EVENTS}, {SQUARE}, {AUTO}, {HARD}, {RUNS},
k1 AS (SELECT rec, i, CASE WHEN state = 1 AND count(*) OVER (PARTITION BY rec, run) < 2 AND max(run) OVER (PARTITION BY rec) > 1 THEN 0 ELSE state END AS state FROM ru),
c1 AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY rec ORDER BY i) THEN 0 ELSE 1 END AS c FROM k1),
r1 AS (SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY i) AS run FROM c1)
SELECT rec, i, CASE WHEN state = 0 AND count(*) OVER (PARTITION BY rec, run) < 2 AND max(run) OVER (PARTITION BY rec) > 1 THEN 1 ELSE state END AS state FROM r1""")
def morph_clean(spark, sf_dir):
    return binarize.cleaned(keyed(spark, sf_dir), 2, 2)


@query(f"WITH {EVENTS}, {SQUARE}, {AUTO}, {HARD} SELECT rec, round(avg(state), 6) AS duty FROM key GROUP BY rec")
def duty_cycle(spark, sf_dir):
    return rounded(binarize.duty_cycle(keyed(spark, sf_dir)), "duty")


FRAGMENTS = f"{keying_sql('conversations', TURN, 10)}"


@query(f"""WITH {FRAGMENTS}, f AS (SELECT *, coalesce(state = 1 AND lag(state, 1) OVER w = 0 AND lag(dur_ms, 1) OVER w < 60 AND lag(state, 2) OVER w = 1, false) AS j FROM seg WINDOW w AS (PARTITION BY rec ORDER BY seg_no)),
n AS (SELECT *, j OR (state = 0 AND coalesce(lead(j) OVER (PARTITION BY rec ORDER BY seg_no), false)) AS inside FROM f),
g AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY seg_no) AS g FROM n)
SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY g) AS seg_no, arg_min(state, seg_no) AS state, round(sum(dur_ms), 6) AS dur_ms FROM g GROUP BY rec, g""")
def merge_fragments(spark, sf_dir):
    return rounded(binarize.merged_fragments(jittered(spark, sf_dir), 60.0), "dur_ms")


# --- timing ---------------------------------------------------------------------------------------------------------------


def jittered(spark, sf_dir):
    from pyspark.sql import Window

    k = keying.keying(turns(spark, sf_dir), "rec", "text", jitter=10)
    return k.select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("pos", "elem", F.desc("state"))).alias("seg_no"), "state", "dur_ms")


def marks_and_spaces(spark, sf_dir):
    segs = jittered(spark, sf_dir)
    return segs.where("state = 1"), segs.where("state = 0")


KEYED = keying_sql("conversations", TURN, 10)
DIT = """q AS (SELECT rec, quantile_cont(dur_ms, [0.25, 0.5, 0.75]) AS p FROM seg WHERE state = 1 GROUP BY rec),
dit AS (SELECT rec, p[3] / greatest(p[1], 1) < 2 AS concentrated, CASE WHEN p[3] / greatest(p[1], 1) < 2 THEN p[2] * 0.85::DOUBLE ELSE p[1] * 1.1::DOUBLE END AS dit FROM q)"""


@query(f"WITH {KEYED}, {DIT} SELECT rec, round(dit, 6) AS dit, round(dit * 3, 6) AS dah, concentrated FROM dit")
def robust_dit(spark, sf_dir):
    return rounded(timing.quartile_dit(marks_and_spaces(spark, sf_dir)[0]), "dit", "dah")


@query(f"""WITH {KEYED}, r AS (SELECT rec, row_number() OVER o AS k, sum(dur_ms) OVER o AS s, sum(dur_ms * dur_ms) OVER o AS q, count(*) OVER p AS n, sum(dur_ms) OVER p AS ts, sum(dur_ms * dur_ms) OVER p AS tq
  FROM seg WHERE state = 1 WINDOW p AS (PARTITION BY rec), o AS (PARTITION BY rec ORDER BY dur_ms, seg_no ROWS UNBOUNDED PRECEDING)),
er AS (SELECT *, round(q - s * s / k + (tq - q) - (ts - s) * (ts - s) / (n - k), 6) AS error FROM r WHERE k < n)
SELECT rec, round(arg_min(s / k, (error, k)), 6) AS low, round(arg_min((ts - s) / (n - k), (error, k)), 6) AS high FROM er GROUP BY rec""")
def kmeans_1d(spark, sf_dir):
    return rounded(timing.two_means(marks_and_spaces(spark, sf_dir)[0]), "low", "high")


@query(f"""WITH {KEYED}, r AS (SELECT rec, dur_ms, row_number() OVER (PARTITION BY rec ORDER BY dur_ms, seg_no) AS k, count(*) OVER (PARTITION BY rec) AS n FROM seg WHERE state = 1),
a AS (SELECT rec, max(n) AS n, median(dur_ms) FILTER (k <= n // 2) * 1.05::DOUBLE AS a, median(dur_ms) FILTER (k > n // 2) * 0.95::DOUBLE AS b, median(dur_ms) AS m FROM r GROUP BY rec),
o AS (SELECT *, b / greatest(a, 1) < 1.8 OR b / greatest(a, 1) > 5 AS odd FROM a)
SELECT rec, round(CASE WHEN n < 2 THEN m WHEN odd THEN m * 0.7::DOUBLE ELSE a END, 6) AS dit, round(CASE WHEN n < 2 THEN m * 3 WHEN odd THEN m * 0.7::DOUBLE * 3 ELSE b END, 6) AS dah FROM o""")
def legacy_dit(spark, sf_dir):
    return rounded(timing.half_medians(marks_and_spaces(spark, sf_dir)[0]), "dit", "dah")


@query(f"""WITH {KEYED}, {DIT}, b AS (SELECT rec, sqrt(dit * (dit * 3)) AS border FROM dit)
SELECT rec, seg_no, CASE WHEN dur_ms > border THEN 'dash' ELSE 'dot' END AS label, round(abs(dur_ms - border) / greatest(border, 1e-6), 6) AS conf FROM seg JOIN b USING (rec) WHERE state = 1""")
def mark_labels(spark, sf_dir):
    marks, _ = marks_and_spaces(spark, sf_dir)
    return rounded(timing.mark_labels(marks, timing.quartile_dit(marks)), "conf").select("rec", "seg_no", "label", "conf")


@query(f"""WITH {KEYED}, {DIT}, a AS (SELECT rec, count(*) AS n, any_value(dit) AS dit, count(*) FILTER (dur_ms >= 1.5 * dit AND dur_ms <= 2.5 * dit) AS near, list_sort(list(dur_ms)) AS d, stddev_pop(dur_ms) AS sd FROM seg JOIN dit USING (rec) WHERE state = 0 GROUP BY rec)
SELECT rec, n >= 8 AND (near > 0.3 * n OR (n >= 10 AND d[n // 4 + 1] <= 2.2 * dit AND d[3 * n // 4 + 1] <= 2.8 * dit AND d[3 * n // 4 + 1] / greatest(d[n // 4 + 1], dit) < 2.2) OR sd > 2.5 * dit) AS odd FROM a""")
def nonstandard(spark, sf_dir):
    marks, spaces = marks_and_spaces(spark, sf_dir)
    return timing.nonstandard_timing(spaces, timing.quartile_dit(marks))


GAP = """l AS (SELECT rec, dur_ms, dit, lead(dur_ms) OVER (PARTITION BY rec ORDER BY dur_ms, seg_no) AS nxt, count(*) OVER (PARTITION BY rec) AS n, row_number() OVER (PARTITION BY rec ORDER BY dur_ms, seg_no) AS k FROM seg JOIN dit USING (rec) WHERE state = 0),
g AS (SELECT rec, arg_max((dur_ms, nxt, round(nxt - dur_ms, 9), dit), (round(nxt - dur_ms, 9), -k)) AS b FROM l WHERE n >= 10 AND dur_ms >= 0.7 * dit AND nxt <= 2.0 * dit GROUP BY rec),
gap AS (SELECT d.rec, CASE WHEN b[3] >= 0.25 * b[4] AND (b[1] + b[2]) / 2 <= 1.7 * b[4] THEN (b[1] + b[2]) / 2 END AS border FROM dit d LEFT JOIN g USING (rec))"""


@query(f"WITH {KEYED}, {DIT}, {GAP} SELECT rec, round(border, 6) AS border FROM gap")
def largest_gap(spark, sf_dir):
    marks, spaces = marks_and_spaces(spark, sf_dir)
    return rounded(timing.largest_gap_border(spaces, timing.quartile_dit(marks)), "border")


@query(f"""WITH {KEYED}, {DIT}, {GAP} SELECT rec, seg_no, CASE WHEN dur_ms < coalesce(border, 2 * dit) THEN 'in_char' WHEN dur_ms < 5 * dit THEN 'char_gap' ELSE 'word_gap' END AS label
FROM seg JOIN dit USING (rec) LEFT JOIN gap USING (rec) WHERE state = 0""")
def gap_fixed(spark, sf_dir):
    marks, spaces = marks_and_spaces(spark, sf_dir)
    dits = timing.quartile_dit(marks)
    return timing.fixed_gaps(spaces, dits, timing.largest_gap_border(spaces, dits)).select("rec", "seg_no", "label")


# --- spectra --------------------------------------------------------------------------------------------------------------

SPECTRUM = f"""{VECTORS}, f AS (SELECT unnest(range(0, 33)) AS bin),
spec AS (SELECT rec, bin, bin * (8000.0::DOUBLE / 64) AS freq, sqrt(pow(sum(v * cos(bin * (8000.0::DOUBLE / 64) * (2 * pi() / 8000) * i)), 2) + pow(sum(v * sin(bin * (8000.0::DOUBLE / 64) * (2 * pi() / 8000) * i)), 2)) AS mag FROM s, f GROUP BY rec, bin)"""


def vector_spectrum(spark, sf_dir):
    return spectral.spectrum(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 8000.0)


@query(f"WITH {VECTORS} SELECT rec AS vec_id, round(pow(sum(v * cos(2 * pi() * 700 / 8000 * i)), 2) + pow(sum(v * sin(2 * pi() * 700 / 8000 * i)), 2), 6) AS power FROM s GROUP BY rec")
def goertzel(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(spectral.goertzel_power(F.col("embedding"), F.lit(700.0), 8000.0), 6).alias("power"))


@query(f"WITH {SPECTRUM} SELECT rec, bin, freq, round(mag, 6) AS mag FROM spec")
def dft_spectrum(spark, sf_dir):
    return rounded(vector_spectrum(spark, sf_dir), "mag")


@query(f"WITH {SPECTRUM} SELECT rec, arg_max(bin, (round(mag, 6), -bin)) AS bin FROM spec WHERE bin > 0 GROUP BY rec")
def dft_peak(spark, sf_dir):
    spec = vector_spectrum(spark, sf_dir).where("bin > 0")
    return spec.groupBy("rec").agg(F.max_by("bin", F.struct(F.round("mag", 6), -F.col("bin"))).alias("bin"))


@query(f"WITH {SPECTRUM} SELECT rec, round(10 * log10(max(mag * mag) / quantile_cont(mag * mag, 0.5)), 6) AS snr FROM spec WHERE freq > 300 AND freq < 1500 GROUP BY rec")
def snr_db(spark, sf_dir):
    return rounded(spectral.snr_db(vector_spectrum(spark, sf_dir)), "snr")


@query(f"""WITH {SPECTRUM}, n AS (SELECT *, lag(mag) OVER (PARTITION BY rec ORDER BY bin) AS l, lead(mag) OVER (PARTITION BY rec ORDER BY bin) AS r, quantile_cont(mag, 0.5) OVER (PARTITION BY rec) AS mid FROM spec)
SELECT rec, bin, round(mag, 6) AS mag FROM n WHERE mag >= l AND mag >= r AND mag > 1.5 * mid""")
def local_peaks(spark, sf_dir):
    return rounded(spectral.local_peaks(vector_spectrum(spark, sf_dir), 1.5), "mag").select("rec", "bin", "mag")


@query(f"""WITH {SPECTRUM}, f2 AS (SELECT label AS rec, sp.rec AS frame, bin, freq, mag FROM spec sp JOIN embeddings e ON e.vec_id = sp.rec),
n AS (SELECT *, lag(mag) OVER w AS l, lead(mag) OVER w AS r, quantile_cont(mag, 0.5) OVER (PARTITION BY rec, frame) AS mid FROM f2 WINDOW w AS (PARTITION BY rec, frame ORDER BY bin)),
t AS (SELECT rec, count(DISTINCT frame) AS frames FROM f2 GROUP BY rec), p AS (SELECT rec, bin, freq, count(*) AS hits, avg(mag) AS mean FROM n WHERE mag >= l AND mag >= r AND mag > 1.5 * mid GROUP BY rec, bin, freq),
q AS (SELECT rec, bin, freq, hits / frames AS presence, mean / (max(mean) OVER (PARTITION BY rec) + 1e-12) AS energy FROM p JOIN t USING (rec))
SELECT rec, bin, freq, round(presence, 6) AS presence, round(energy * (0.4 + 0.6 * presence) * least(greatest(1 - abs(presence - 0.35), 0.05), 1), 6) AS score FROM q""")
def stft_tracks(spark, sf_dir):
    """Vectors of one label as the frames of a recording: how often and how strongly a bin peaks."""
    frames = vector_spectrum(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), F.col("rec") == F.col("vec_id"))
    return rounded(spectral.scored_tracks(frames.select(F.col("label").alias("rec"), F.col("vec_id").alias("frame"), "bin", "freq", "mag"), 1.5), "presence", "score")


@query(f"""WITH {VECTORS}, h AS (SELECT rec, i, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 63)) AS v FROM s), g AS (SELECT unnest(range(0, 49)) AS k),
p AS (SELECT rec, 750 - 12.0::DOUBLE + k * 0.5::DOUBLE AS freq, round(pow(sum(v * cos((750 - 12.0::DOUBLE + k * 0.5::DOUBLE) * (2 * pi() / 8000) * i)), 2) + pow(sum(v * sin((750 - 12.0::DOUBLE + k * 0.5::DOUBLE) * (2 * pi() / 8000) * i)), 2), 6) AS power FROM h, g GROUP BY rec, k)
SELECT rec, arg_max(freq, (power, -freq)) AS freq, max(power) AS power FROM p GROUP BY rec""")
def afc_grid(spark, sf_dir):
    return spectral.refined_frequency(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, F.lit(750.0), 8000.0, 12.0, 0.5)


@query(f"WITH {VECTORS} SELECT rec, i, round(v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 63)), 6) + 0 AS v FROM s")
def hann_block(spark, sf_dir):
    block = F.posexplode(spectral.windowed(F.col("embedding"), 64)).alias("i", "v")
    return rounded(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), block), "v")


@query(f"""WITH RECURSIVE {SPECTRUM}, o AS (SELECT rec, freq, round(mag, 6) AS score, row_number() OVER (PARTITION BY rec ORDER BY round(mag, 6) DESC, freq) AS k FROM spec),
r AS (SELECT rec, 1 AS k, [freq] AS kept FROM o WHERE k = 1 UNION ALL
  SELECT o.rec, o.k, CASE WHEN len(r.kept) < 6 AND len(list_filter(r.kept, lambda x: abs(x - o.freq) < 300)) = 0 THEN list_append(r.kept, o.freq) ELSE r.kept END FROM r JOIN o ON o.rec = r.rec AND o.k = r.k + 1),
z AS (SELECT rec, arg_max(kept, k) AS kept FROM r GROUP BY rec), y AS (SELECT rec, unnest(kept) AS freq FROM z)
SELECT y.rec, y.freq, o.score FROM y JOIN o ON o.rec = y.rec AND o.freq = y.freq""")
def nms_candidates(spark, sf_dir):
    spec = vector_spectrum(spark, sf_dir).select("rec", "freq", F.round("mag", 6).alias("score"))
    return spectral.separated(spec, 300.0, 6)


@query(f"""WITH {EVENTS}, b AS (SELECT rec, i, v, count(*) OVER (PARTITION BY rec) // 8 AS nb FROM s),
m AS (SELECT rec, i // 8 AS b, sqrt(pow(sum(v * (0.5::DOUBLE - 0.5::DOUBLE * cos((i % 8) * (2 * pi() / 7))) * cos((i % 8) * (2 * pi() * 700 / 8000))), 2) + pow(sum(v * (0.5::DOUBLE - 0.5::DOUBLE * cos((i % 8) * (2 * pi() / 7))) * sin((i % 8) * (2 * pi() * 700 / 8000))), 2)) AS v FROM b WHERE i < nb * 8 GROUP BY rec, i // 8),
t AS (SELECT rec, b, CASE WHEN count(*) OVER (PARTITION BY rec) >= 5 THEN 0.15::DOUBLE * lead(v, 1, 0) OVER w + 0.7::DOUBLE * v + 0.15::DOUBLE * lag(v, 1, 0) OVER w ELSE v END AS smooth FROM m WINDOW w AS (PARTITION BY rec ORDER BY b)),
e AS (SELECT b.rec, b.i, smooth FROM b JOIN t ON t.rec = b.rec AND t.b = least(b.i // 8, b.nb - 1)), a AS (SELECT rec, i, {ma('smooth', 8)} AS m FROM e)
SELECT rec, i, round({norm('m')}, 6) AS env FROM a""")
def goertzel_env(spark, sf_dir):
    return rounded(spectral.goertzel_envelope(samples(spark, sf_dir), 700.0, 8000.0, 8), "env")


# --- scores and votes -----------------------------------------------------------------------------------------------------

LETTERS = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
WORDS = "list_filter(string_split(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 2)"
MONO = f"""l AS (SELECT doc_id, text, {LETTERS} AS t FROM documents),
mono AS (SELECT doc_id, text, CASE WHEN length(t) >= 8 THEN list_max(list_transform(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''), lambda c: length(t) - length(replace(t, c, '')))) / length(t) ELSE 0 END AS mono FROM l)"""
KNOWN = ", ".join(f"'{w}'" for w in PLAUSIBLE)
PLAUS = f"""{MONO}, v AS (SELECT *, {WORDS} AS w FROM mono), w AS (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]{{2,12}}$'))) AS wordy FROM v),
pl AS (SELECT doc_id, text, mono, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 0.2 ELSE least(greatest(CASE WHEN mono > 0.5 THEN 0.2 WHEN mono > 0.42 THEN 0.35 WHEN mono > 0.35 THEN 0.7 ELSE 1.0 END::DOUBLE
  * CASE WHEN wordy >= 3 AND 2 * wordy >= len(w) THEN 1 + 0.025::DOUBLE * least(wordy, 6) ELSE 1 END * (1 + 0.02::DOUBLE * least(len(list_filter(w, lambda x: x IN ({KNOWN}))), 5)), 0.15), 1.25) END AS plausibility FROM w)"""


@query(f"WITH {MONO} SELECT doc_id, round(mono, 6) AS mono FROM mono")
def dominant_char(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(scoring.dominant_letter(F.col("text")), 6).alias("mono"))


@query(f"WITH {PLAUS} SELECT doc_id, round(plausibility, 6) AS plausibility FROM pl")
def plausibility(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(scoring.plausibility(F.col("text")), 6).alias("plausibility"))


EXCHANGE = "format('{}5NN{:04d} TU {} 1NN {:03d}', c_mktsegment[1:2] || c_custkey % 10 || 'AB', 2000 + c_custkey % 300, c_mktsegment[1:1] || (10 + c_custkey % 90) || 'XY', 100 + c_custkey % 800)"


def exchanges(spark, sf_dir):
    """A contest exchange rendered from each customer."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    call = F.concat(F.substring("c_mktsegment", 1, 2), (k % 10).cast("string"), F.lit("AB"))
    other = F.concat(F.substring("c_mktsegment", 1, 1), (10 + k % 90).cast("string"), F.lit("XY"))
    return c.select("c_custkey", F.format_string("%s5NN%04d TU %s 1NN %03d", call, 2000 + k % 300, other, 100 + k % 800).alias("text"))


@query(f"WITH x AS (SELECT c_custkey, {EXCHANGE} AS t FROM customer) SELECT c_custkey, len(regexp_extract_all(t, '[15E]NN')) >= 2 AND len(regexp_extract_all(t, '[0-9]{{3,4}}')) >= 2 AND (t LIKE '%TU%' OR len(regexp_extract_all(t, '[15E]NN')) >= 3) AS contest, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[15E]NN ?([0-9]{{3,4}})', 1))), ',') AS serials FROM x")
def contest_exchanges(spark, sf_dir):
    x = exchanges(spark, sf_dir)
    return x.select("c_custkey", scoring.contest_like(F.col("text")).alias("contest"), F.array_join(scoring.serials(F.col("text")), ",").alias("serials"))


@query(f"""WITH x AS (SELECT c_custkey, regexp_extract_all({EXCHANGE} || ' DE E5E ' || c_mktsegment[1:1] || c_custkey % 10 || 'K', '\\b(?:[A-Z]{{1,2}}[0-9]+[A-Z]{{1,4}}|[A-Z][0-9]{{2}}[A-Z]{{1,4}})\\b') AS c FROM customer)
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(c, lambda k: NOT regexp_matches(k, '^[EI]+[0-9]*[EI]*$')))), ',') AS calls FROM x""")
def contest_calls(spark, sf_dir):
    own = F.concat("text", F.lit(" DE E5E "), F.substring("text", 1, 1), (F.col("c_custkey") % 10).cast("string"), F.lit("K"))
    return exchanges(spark, sf_dir).select("c_custkey", F.array_join(scoring.calls(own), ",").alias("calls"))


def hypotheses(spark, sf_dir):
    """Events as hypotheses: a text, a score and a speed for each user."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("hyp_id"), F.upper("event_type").alias("text"), (F.col("value") / 500.0).alias("score"), (5 + F.col("event_id") % 40).cast("double").alias("wpm"))


HYPS = "h AS (SELECT user_id, event_id AS hyp_id, upper(event_type) AS text, value / 500.0::DOUBLE AS score, (5 + event_id % 40)::DOUBLE AS wpm FROM events)"


@query(f"WITH {HYPS} SELECT * FROM (SELECT user_id, hyp_id, text, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, hyp_id) AS rank FROM h) WHERE rank <= 3")
def topk_hypotheses(spark, sf_dir):
    return rounded(scoring.best_hypotheses(hypotheses(spark, sf_dir), "user_id", 3).drop("wpm"), "score")


@query(f"WITH {HYPS}, g AS (SELECT user_id, text, count(*) AS votes, avg(score) AS score FROM h GROUP BY user_id, text), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(votes * score, 9) DESC, text) AS k FROM g) SELECT user_id, text, votes, round(score, 6) AS score FROM b WHERE k = 1")
def consensus_vote(spark, sf_dir):
    return rounded(scoring.consensus(hypotheses(spark, sf_dir), "user_id"), "score")


@query(f"""WITH {HYPS}, m AS (SELECT user_id, list_sort(list(wpm)) AS w FROM h WHERE wpm > 0 GROUP BY user_id), d AS (SELECT user_id, w[len(w) // 2 + 1] AS mid FROM m WHERE len(w) >= 3)
SELECT user_id, hyp_id, round(score * CASE WHEN mid IS NULL THEN 1 WHEN wpm <= 0 THEN 0.8 WHEN abs(wpm - mid) / greatest(mid, 1) < 0.2 THEN 1.2 WHEN abs(wpm - mid) / greatest(mid, 1) < 0.5 THEN 1 ELSE 0.7 END::DOUBLE, 6) AS adjusted FROM h LEFT JOIN d USING (user_id)""")
def wpm_consensus(spark, sf_dir):
    return rounded(scoring.speed_consensus(hypotheses(spark, sf_dir), "user_id"), "adjusted").select("user_id", "hyp_id", "adjusted")


@query("""WITH s AS (SELECT DISTINCT o_orderstatus AS grp, o_orderkey AS serial FROM orders), r AS (SELECT grp, unnest(range(min(serial), max(serial) + 1)) AS serial FROM s GROUP BY grp)
SELECT r.grp, r.serial FROM r ANTI JOIN s ON s.grp = r.grp AND s.serial = r.serial""")
def missing_serials(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("serial"))
    return scoring.missing_serials(o, "grp", "serial")


@query(f"""WITH {PLAUS.replace('FROM documents)', 'FROM (SELECT doc_id, ' + KEYABLE + ' AS text FROM documents))')}, d AS (SELECT doc_id, {KEYABLE} AS t, 0.3::DOUBLE + (doc_id % 30) / 100.0::DOUBLE AS duty, (20 + doc_id % 100)::DOUBLE AS dit, (20 + doc_id % 100) * (2 + (doc_id % 3))::DOUBLE AS dah, plausibility FROM pl),
x AS (SELECT *, replace(t, ' ', '') AS solid FROM d), y AS (SELECT *, length(solid) AS n, length(solid) - length(translate(solid, '?&', '')) AS bad, length(replace(solid, '?', '')) AS valid,
  len(list_filter(string_split(replace(t, '?', ' '), ' '), lambda k: length(k) >= 3)) >= 3 AS several, list_unique(list_filter(string_split(replace(solid, '?', ''), ''), lambda c: c <> '')) AS kinds FROM x),
z AS (SELECT *, valid / greatest(n, 1) * least(greatest(1 - abs(duty - 0.4), 0.4), 1) * CASE WHEN 1200 / dit < 3 OR 1200 / dit > 140 THEN 0.1 WHEN 1200 / dit < 5 THEN 0.4 WHEN 1200 / dit > 100 THEN 0.55 WHEN 1200 / dit > 85 THEN 0.8 ELSE 1 END::DOUBLE
  * CASE WHEN dah / dit < 1.5 OR dah / dit > 6 THEN 0.3 WHEN dah / dit < 2 OR dah / dit > 4.5 THEN 0.6 ELSE 1 END::DOUBLE AS sc FROM y)
SELECT doc_id, round(least(greatest((CASE WHEN valid < 10 THEN sc * valid / 10 ELSE sc END)
  * CASE WHEN valid > 3 AND kinds / least(greatest(valid, 1), 26) < 0.15 THEN 0.5 WHEN valid > 20 AND kinds / least(greatest(valid, 1), 26) > 0.85 THEN 0.8 ELSE 1 END::DOUBLE
  * CASE WHEN bad / greatest(n, 1) > 0.25 THEN 0.5 WHEN bad / greatest(n, 1) > 0.05 THEN CASE WHEN several THEN 0.75 ELSE 0.6 END WHEN bad >= 2 THEN CASE WHEN several THEN 0.85 ELSE 0.7 END ELSE 1 END::DOUBLE * plausibility, 0), 1), 6) AS score FROM z""")
def decode_score(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    dit = (20 + k % 100).cast("double")
    return d.select("doc_id", F.round(scoring.decode_score(keying.keyable(F.col("text")), 0.3 + (k % 30) / 100.0, dit, dit * (2 + k % 3)), 6).alias("score"))


# --- text repair ----------------------------------------------------------------------------------------------------------


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer")


@query()
def contest_runon(spark, sf_dir):
    x = exchanges(spark, sf_dir)
    glued = F.concat("text", F.lit(" R5NN EEEI 5NNT8"), (F.col("c_custkey") % 10).cast("string"))
    return x.select("c_custkey", repair.split_runons(glued).alias("text"))


RUNON = "upper(t)"
for _pattern, _by in repair_text.RUN_ON:
    RUNON = f"regexp_replace({RUNON}, '{_pattern}', '{_by}', 'g')"
ORACLE_SQL["contest_runon"] = f"""WITH x AS (SELECT c_custkey, {EXCHANGE} || ' R5NN EEEI 5NNT8' || c_custkey % 10 AS t FROM customer), y AS (SELECT c_custkey, {RUNON} AS t FROM x)
SELECT c_custkey, array_to_string(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '{repair_text.NOISE.pattern}')), ' ') AS text FROM y"""


MONO_OF = "CASE WHEN length(l) >= 8 THEN list_max(list_transform(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''), lambda c: length(l) - length(replace(l, c, '')))) / length(l) ELSE 0 END"


@query(f"""WITH x AS ({ORACLE_SQL["contest_runon"]}), y AS (SELECT c_custkey, text AS t, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l, (length(text) - length(replace(text, ' ', ''))) / greatest(length(text), 1) AS sp FROM x),
z AS (SELECT *, {MONO_OF} AS mono, CASE WHEN sp >= 0.08 THEN 0.35 WHEN sp >= 0.04 THEN 0.15 ELSE 0 END::DOUBLE + least(0.25, 0.05::DOUBLE * len(regexp_extract_all(t, '\\b5NN\\b'))) + least(0.15, 0.03::DOUBLE * len(regexp_extract_all(t, '\\bTU\\b')))
  + least(0.15, 0.03::DOUBLE * len(regexp_extract_all(t, '\\b[0-9]{{3,4}}\\b'))) + least(0.20, 0.04::DOUBLE * len(regexp_extract_all(t, '\\b(?:[A-Z]{{1,2}}[0-9]+[A-Z]{{1,4}}|[A-Z][0-9]{{2}}[A-Z]{{1,4}})\\b'))) AS q FROM y)
SELECT c_custkey, round(CASE WHEN length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) < 8 THEN 0 ELSE least(1, q * CASE WHEN mono > 0.45 THEN 0.3 WHEN mono > 0.35 THEN 0.6 ELSE 1 END::DOUBLE) END, 6) AS quality FROM z""")
def contest_quality(spark, sf_dir):
    split = contest_runon(spark, sf_dir)
    return split.select("c_custkey", F.round(scoring.contest_quality(F.col("text")), 6).alias("quality"))


def contest_audio(spark, sf_dir):
    """An exchange keyed for each nation."""
    k = F.col("n_nationkey")
    text = F.format_string("YO%dAAC 5NN %04d TU DL%dABC 5NN %04d TU", k % 10, 2000 + k, (k + 3) % 10, 2001 + k)
    n = table(spark, sf_dir, "nation").select(k.cast("string").alias("id"), text.alias("t")).repartition(8)
    return audio.synthesized(n, "id", "t", 4000, 700.0, 25.0)


@query()
def contest_transcript(spark, sf_dir):
    """Exchanges decoded in overlapping windows and stitched."""
    return rounded(contest.transcript(contest_audio(spark, sf_dir), 700.0, 16.0, 9.0), "score", places=4)


@query(f"""WITH n AS (SELECT p_partkey, lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS n FROM part), u(r) AS (VALUES {", ".join(f"('{r}')" for r in USUAL_REPORTS)}),
c AS (SELECT p_partkey, n, r, CASE WHEN n[2:3] = r[2:3] THEN 1 WHEN n[1:1] || n[3:3] = r[1:1] || r[3:3] THEN 2 WHEN n[1:2] = r[1:2] THEN 3 END AS j FROM n, u)
SELECT p_partkey, coalesce(CASE WHEN count(*) FILTER (n = r) > 0 THEN any_value(n) ELSE arg_min(r, (j, r)) FILTER (j IS NOT NULL) END, any_value(n)) AS report FROM c GROUP BY p_partkey""")
def rst_snap(spark, sf_dir):
    n = F.format_string("%03d", F.col("p_partkey") % 1000)
    return table(spark, sf_dir, "part").select("p_partkey", repair.snapped(n).alias("report"))


@query(f"WITH x AS (SELECT c_custkey, unnest(string_split({EXCHANGE}, ' ')) AS token FROM customer) SELECT c_custkey, token, regexp_matches(token, '{CALL_PATTERN}') AND NOT regexp_matches(token, '^(?:[15E]NN|[1-5]NN)$') AS is_call FROM x")
def callsign_shape(spark, sf_dir):
    x = exchanges(spark, sf_dir).select("c_custkey", F.explode(F.split("text", " ")).alias("token"))
    return x.select("c_custkey", "token", repair.call_shaped(F.col("token")).alias("is_call"))


@query("SELECT c_custkey, array_to_string(list_filter(list_transform(string_split(replace(c_mktsegment, 'I', '<AR>') || ' <SK> <AR><KN> K', ' '), lambda t: CASE WHEN t IN ('<AR>', '<SK>', '<KN>') THEN t ELSE regexp_replace(t, '<(AR|SK|KN)>', '', 'g') END), lambda t: t <> ''), ' ') AS text FROM customer")
def spurious_prosigns(spark, sf_dir):
    text = F.concat(F.replace("c_mktsegment", F.lit("I"), F.lit("<AR>")), F.lit(" <SK> <AR><KN> K"))
    return customers(spark, sf_dir).select("c_custkey", repair.without_prosigns(text).alias("text"))


@query("SELECT c_custkey, array_to_string(list_transform(list_transform(string_split('/' || c_mktsegment || '( A&' || c_custkey || ' ?PY?', ' '), lambda t: replace(regexp_replace(replace(t, '(', 'NG'), '^/', 'C'), '&', '')), lambda t: CASE WHEN t = '?PY?' THEN 'CPY?' ELSE t END), ' ') AS text FROM customer")
def special_chars(spark, sf_dir):
    text = F.concat(F.lit("/"), "c_mktsegment", F.lit("( A&"), F.col("c_custkey").cast("string"), F.lit(" ?PY?"))
    return customers(spark, sf_dir).select("c_custkey", repair.cleaned_specials(text).alias("text"))


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


_V = repair.Vocabulary()


@query(f"""WITH x AS (SELECT c_custkey, unnest(range(1, 7)) AS p, string_split('AGN= =TNX ?WATER ' || c_custkey || '= ' || c_mktsegment || '= ?' || c_mktsegment, ' ') AS w FROM customer),
t AS (SELECT c_custkey, p, w[p] AS t, upper(regexp_replace(w[p], '=$', '')) AS h, upper(regexp_replace(w[p], '^[=?]', '')) AS b FROM x),
o AS (SELECT c_custkey, p, CASE WHEN length(t) > 1 AND t LIKE '%=' AND (list_contains({_quoted(_V.abbreviations | _V.q_codes | set(_V.word_fixes))}, h) OR regexp_matches(h, '^[0-9]+$')) THEN h || ' ='
  WHEN length(t) > 1 AND t LIKE '=%' AND list_contains({_quoted(_V.abbreviations | _V.q_codes | set(_V.word_fixes) | _V.words)}, b) THEN '= ' || b
  WHEN length(t) > 1 AND t LIKE '?%' AND list_contains({_quoted(_V.words | _V.abbreviations)}, b) THEN b ELSE t END AS t FROM t)
SELECT c_custkey, string_agg(t, ' ' ORDER BY p) AS text FROM o GROUP BY c_custkey""")
def detach_prosign(spark, sf_dir):
    text = F.concat(F.lit("AGN= =TNX ?WATER "), F.col("c_custkey").cast("string"), F.lit("= "), "c_mktsegment", F.lit("= ?"), "c_mktsegment")
    return customers(spark, sf_dir).select("c_custkey", repair.detached(text).alias("text"))


@query(f"""WITH t AS (SELECT DISTINCT unnest(string_split({KEYABLE}, ' ')) AS word FROM documents), v AS (SELECT unnest({_quoted(KNOWN_WORDS)}) AS known)
SELECT word, min(known) AS fixed FROM t JOIN v ON abs(length(word) - length(known)) <= 1 AND levenshtein(word, known) = 1 WHERE length(word) >= 3 AND regexp_matches(word, '^[A-Z]+$') AND word NOT IN (SELECT known FROM v) GROUP BY word""")
def fuzzy_fix(spark, sf_dir):
    known = spark.createDataFrame([(w,) for w in sorted(KNOWN_WORDS)], "word string")
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(keying.keyable(F.col("text")), " ")).alias("word")).where("length(word) >= 3 and word rlike '^[A-Z]+$'").distinct()
    return repair.nearest_words(words.join(F.broadcast(known), "word", "left_anti"), known)


@query(f"""WITH x AS (SELECT c_custkey, unnest(string_split({EXCHANGE}, ' ')) AS token FROM customer), k AS (SELECT unnest({_quoted(KNOWN_CALLS)}) AS known),
d AS (SELECT c_custkey, token, arg_min(known, (levenshtein(token, known), known)) AS call, min(levenshtein(token, known)) AS distance FROM x, k GROUP BY c_custkey, token) SELECT * FROM d WHERE distance <= 4""")
def known_nearest(spark, sf_dir):
    x = exchanges(spark, sf_dir).select("c_custkey", F.explode(F.split("text", " ")).alias("token")).distinct()
    near = F.array_min(F.transform(F.array(*[F.lit(k) for k in KNOWN_CALLS]), lambda k: F.struct(F.levenshtein("token", k).alias("d"), k.alias("k"))))
    return x.select("c_custkey", "token", near.alias("n")).where("n.d <= 4").select("c_custkey", "token", F.col("n.k").alias("call"), F.col("n.d").alias("distance"))


@query()
def semantic_correct(spark, sf_dir):
    text = F.concat("text", F.lit(" UR RSA 59"), (F.col("c_custkey") % 10).cast("string"), F.lit(" TNK THEFIRST STATIOM K"))
    x = exchanges(spark, sf_dir).select("c_custkey", text.alias("raw"))
    return repair.semantic_correct(x, "c_custkey", "raw").select("c_custkey", "text", F.size("corrections").alias("corrections"), F.array_join(F.array_distinct(F.transform("corrections", lambda c: c.type)), ",").alias("types"))


@query()
def context_rules(spark, sf_dir):
    x = customers(spark, sf_dir).select("c_custkey", F.concat(F.lit("FB QSK KE W1AW UR 599 1 NAME "), "c_mktsegment", F.lit(" CQ THE DE K3EST")).alias("raw"))
    return repair.semantic_correct(x, "c_custkey", "raw", phases=(repair_text.qso_context,)).select("c_custkey", "text", F.size("corrections").alias("corrections"))


@query()
def word_break(spark, sf_dir):
    """All known words of each conversation turn that has any, run together and parted again."""
    words = F.filter(F.split(keying.keyable(F.col("text")), " "), lambda w: F.array_contains(F.array(*[F.lit(k) for k in sorted(KNOWN_WORDS)]), w))
    x = turns(spark, sf_dir).select("rec", F.array_join(words, "").alias("raw")).where("raw <> ''")
    return repair.semantic_correct(x, "rec", "raw", phases=(repair_text.merged_words,)).select("rec", "raw", "text")


@query(f"SELECT {TURN} AS rec, {KEYABLE} AS text FROM conversations WHERE len(string_split({KEYABLE}, ' ')) // 2 > 4")
def overlap_stitch(spark, sf_dir):
    """Each turn of a conversation cut into two windows that overlap by four words, stitched back."""
    from pyspark.sql.types import StringType

    w = F.split(keying.keyable(F.col("text")), " ")
    x = turns(spark, sf_dir).select("rec", w.alias("w"), (F.size(w) / 2).cast("int").alias("h")).where("h > 4")
    join = F.udf(lambda a, b: repair_text.stitched(a, b), StringType(), useArrow=True)
    return x.select("rec", join(F.array_join(F.slice("w", F.lit(1), F.col("h")), " "), F.array_join(F.slice("w", F.col("h") - 3, F.size("w")), " ")).alias("text"))


# --- recordings by kernels: blocks of 64 values are recordings ---------------------------------------------------------------

BLOCKS = VECTORS.replace("s AS (", "s AS MATERIALIZED (", 1)
FS = 8000


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), "embedding")


GAIN_ENV = 1 - math.exp(-1 / (0.5 * FS))


def gain_sql(attack: float, release: float) -> str:
    fall, rise = float(kernels.gain_alpha(FS, attack)), float(kernels.gain_alpha(FS, release))
    want = "least(greatest(0.7::DOUBLE / (env + 1e-6), 0.1), 50)"
    change = lambda g: f"{g} + CASE WHEN {want} > {g} THEN {rise!r}::DOUBLE ELSE {fall!r}::DOUBLE END * ({want} - {g})"
    first = f"rec, i, v, env, {change('1.0')} AS gain FROM (SELECT *, abs(v) AS env FROM s)"
    step = f"rec, i, v, env, {change('gain')} AS gain FROM (SELECT s.rec, s.i, s.v, r.env + {GAIN_ENV!r}::DOUBLE * (abs(s.v) - r.env) AS env, r.gain FROM r JOIN s ON s.rec = r.rec AND s.i = r.i + 1)"
    return f"WITH RECURSIVE {BLOCKS}, r AS (SELECT {first} WHERE i = 0 UNION ALL SELECT {step})"


def fast_gain_sql(attack: float, release: float) -> str:
    alpha = float(kernels.gain_alpha(FS, attack) + kernels.gain_alpha(FS, release)) / 2
    want = "least(greatest(0.7::DOUBLE / (env + 1e-6), 0.1), 50)"
    first = f"rec, i, v, env, {alpha!r}::DOUBLE * {want} AS gain FROM (SELECT *, {GAIN_ENV!r}::DOUBLE * abs(v) AS env FROM s)"
    step = f"rec, i, v, env, (1 - {alpha!r}::DOUBLE) * gain + {alpha!r}::DOUBLE * {want} AS gain FROM (SELECT s.rec, s.i, s.v, (1 - {GAIN_ENV!r}::DOUBLE) * r.env + {GAIN_ENV!r}::DOUBLE * abs(s.v) AS env, r.gain FROM r JOIN s ON s.rec = r.rec AND s.i = r.i + 1)"
    return f"WITH RECURSIVE {BLOCKS}, r AS (SELECT {first} WHERE i = 0 UNION ALL SELECT {step}) SELECT rec, i, round(least(greatest(v * least(greatest(gain, 0.1), 50), -1), 1), 6) AS v FROM r"


@query(gain_sql(50, 2000) + " SELECT rec, i, round(least(greatest(v * gain, -1), 1), 6) AS v, round(env, 6) AS env, round(gain, 6) AS gain FROM r")
def gain_samples(spark, sf_dir):
    return rounded(whole.gained(vectors(spark, sf_dir), "rec", "embedding", FS), "v", "env", "gain")


@query(fast_gain_sql(50, 2000))
def gain_slow(spark, sf_dir):
    return rounded(whole.gain_mode(vectors(spark, sf_dir), "rec", "embedding", FS, "slow"), "v")


@query(fast_gain_sql(20, 500))
def gain_fast(spark, sf_dir):
    return rounded(whole.gain_mode(vectors(spark, sf_dir), "rec", "embedding", FS, "fast"), "v")


@query(fast_gain_sql(50, 1000))
def fading_compensated(spark, sf_dir):
    return rounded(whole.fading_compensated(vectors(spark, sf_dir), "rec", "embedding", FS, 2.0), "v")


@query(gain_sql(50, 2000) + """ SELECT rec, round(avg(gain), 6) AS avg_gain, round(min(gain), 6) AS min_gain, round(max(gain), 6) AS max_gain, round(20 * log10(max(gain) / (min(gain) + 1e-6)), 6) AS range_db, round(avg(env), 6) AS env_mean, round(stddev_pop(env), 6) AS env_std FROM r GROUP BY rec""")
def gain_diagnostics(spark, sf_dir):
    return rounded(whole.gain_diagnostics(whole.gained(vectors(spark, sf_dir), "rec", "embedding", FS)), "avg_gain", "min_gain", "max_gain", "range_db", "env_mean", "env_std")


def loop_sql(f0: float, bandwidth: float, damping: float = 0.707, reach: float = 20.0) -> str:
    wn = 2 * math.pi * bandwidth / (damping + 1 / (4 * damping)) / FS
    d = 1 + 2 * damping * wn + wn * wn
    alpha, beta = 2 * damping * wn / d, wn * wn / d
    err = "sign(v * cos(phase)) * (-v * sin(phase))"
    move = f"""rec, i, f AS freq, atan2(sin(p), cos(p)) AS phase, re, im FROM (SELECT rec, i, f, re, im, phase + {2 * math.pi / FS!r}::DOUBLE * f + {alpha!r}::DOUBLE * err AS p
  FROM (SELECT rec, i, phase, re, im, err, least(greatest(freq + {beta * FS!r}::DOUBLE * err, {f0 - reach}), {f0 + reach}) AS f FROM (SELECT rec, i, freq, phase, v * cos(phase) AS re, -v * sin(phase) AS im, {err} AS err"""
    first = f"{move} FROM (SELECT rec, i, v, {f0}::DOUBLE AS freq, 0.0::DOUBLE AS phase FROM s WHERE i = 0))))"
    step = f"{move} FROM (SELECT s.rec, s.i, s.v, r.freq, r.phase FROM r JOIN s ON s.rec = r.rec AND s.i = r.i + 1))))"
    return f"WITH RECURSIVE {BLOCKS}, r AS (SELECT {first} UNION ALL SELECT {step})"


@query(loop_sql(700.0, 10.0) + " SELECT rec, i, round(freq, 5) AS freq, round(cos(phase), 5) + 0 AS turn, round(re, 5) + 0 AS re, round(im, 5) + 0 AS im FROM r")
def carrier_loop(spark, sf_dir):
    rows = whole.carrier(vectors(spark, sf_dir), "rec", "embedding", FS, 700.0).withColumn("turn", F.cos("phase")).drop("phase")
    return rows.select("rec", "i", *[(F.round(c, 5) + 0).alias(c) for c in ("freq", "turn", "re", "im")])


@query(loop_sql(700.0, 5.0) + """, n AS (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM r)
SELECT rec, max(n) > 40 AND stddev_pop(freq) FILTER (i >= n - 40) < 1 AS locked, round(arg_max(freq, i), 5) AS current, round(avg(freq), 5) AS avg_freq, max(n) AS samples FROM n GROUP BY rec""")
def loop_lock(spark, sf_dir):
    tracks = whole.carrier(vectors(spark, sf_dir), "rec", "embedding", FS, 700.0, 5.0)
    return rounded(whole.lock_status(tracks, 700.0, 40), "current", "avg_freq", places=5).select("rec", "locked", "current", "avg_freq", "samples")


@query(f"""WITH RECURSIVE {BLOCKS}, r AS (SELECT rec, i, 0.2::DOUBLE * v AS y FROM s WHERE i = 0 UNION ALL SELECT s.rec, s.i, 0.8::DOUBLE * r.y + 0.2::DOUBLE * s.v FROM r JOIN s ON s.rec = r.rec AND s.i = r.i + 1)
SELECT rec, i, round(y, 6) + 0 AS v FROM r""")
def ema_series(spark, sf_dir):
    return whole.exponential_series(vectors(spark, sf_dir), "rec", "embedding", 0.2).select("rec", "i", (F.round("v", 6) + 0).alias("v"))


def spectrum_filter_sql(power: str) -> str:
    """A response over frequencies f applied to blocks that are odd-extended by 63 samples at both ends."""
    return f"""WITH {BLOCKS}, x0 AS (SELECT rec, min(v) FILTER (i = 0) AS a, min(v) FILTER (i = 63) AS z FROM s GROUP BY rec),
e AS MATERIALIZED (SELECT rec, i + 63 AS j, v FROM s UNION ALL SELECT rec, 63 - i, 2 * a - v FROM s JOIN x0 USING (rec) WHERE i > 0 UNION ALL SELECT rec, 189 - i, 2 * z - v FROM s JOIN x0 USING (rec) WHERE i < 63),
b AS (SELECT b, b * ({FS}::DOUBLE / 256) AS f FROM (SELECT unnest(range(0, 129)) AS b)), p AS MATERIALIZED (SELECT b, ({power}) * CASE WHEN b IN (0, 128) THEN 1 ELSE 2 END / 256.0::DOUBLE AS p FROM b),
t AS MATERIALIZED (SELECT k, cos(k * (2 * pi() / 256)) AS c, sin(k * (2 * pi() / 256)) AS s FROM (SELECT unnest(range(0, 256)) AS k)),
d AS MATERIALIZED (SELECT rec, p.b, p * sum(v * t.c) AS re, p * sum(v * t.s) AS im FROM e, p JOIN t ON t.k = (p.b * j) % 256 GROUP BY rec, p.b, p)
SELECT rec, i, round(sum(re * t.c + im * t.s), 6) + 0 AS v FROM d, (SELECT unnest(range(0, 64)) AS i) JOIN t ON t.k = (d.b * (i + 63)) % 256 GROUP BY rec, i"""


_A, _B = math.tan(math.pi * 640 / FS), math.tan(math.pi * 760 / FS)
_WARP = f"greatest(tan(pi() * least(f, {FS / 2 * 0.999999!r}) / {FS}), 1e-12)"
_W0, _C0 = 2 * math.pi * 60 / FS, math.cos(2 * math.pi * 60 / FS)
_G = 1 / (1 + math.tan(_W0 / 60))
_W = f"(2 * pi() * f / {FS})"


@query(spectrum_filter_sql(f"1 / (1 + pow(({_WARP} * {_WARP} - {_A * _B!r}::DOUBLE) / ({_WARP} * {_B - _A!r}::DOUBLE), 8))"))
def bandpass(spark, sf_dir):
    return whole.bandpassed(vectors(spark, sf_dir), "rec", "embedding", FS, 640, 760).select("rec", "i", (F.round("v", 6) + 0).alias("v"))


@query(spectrum_filter_sql(f"""{_G * _G!r}::DOUBLE * (pow(1 - {2 * _C0!r}::DOUBLE * cos({_W}) + cos(2 * {_W}), 2) + pow({2 * _C0!r}::DOUBLE * sin({_W}) - sin(2 * {_W}), 2))
  / (pow(1 - {2 * _G * _C0!r}::DOUBLE * cos({_W}) + {2 * _G - 1!r}::DOUBLE * cos(2 * {_W}), 2) + pow({2 * _G * _C0!r}::DOUBLE * sin({_W}) - {2 * _G - 1!r}::DOUBLE * sin(2 * {_W}), 2))"""))
def hum_notch(spark, sf_dir):
    return whole.notched(vectors(spark, sf_dir), "rec", "embedding", FS).select("rec", "i", (F.round("v", 6) + 0).alias("v"))


TAPS = ", ".join(f"({k}, {h!r}::DOUBLE)" for k, h in enumerate(kernels.resampling_filter(1, 2).tolist()))


@query(f"""WITH {BLOCKS}, h(k, h) AS (VALUES {TAPS}), o AS (SELECT unnest(range(0, 32)) AS m)
SELECT rec, m AS i, round(sum(v * h), 6) + 0 AS v FROM o JOIN h ON true JOIN s ON s.i = 2 * m + 20 - k GROUP BY rec, m""")
def resample_to_8k(spark, sf_dir):
    return whole.resampled(vectors(spark, sf_dir), "rec", "embedding", 16000).select("rec", "i", (F.round("v", 6) + 0).alias("v"))


def block_samples(spark, sf_dir):
    return vectors(spark, sf_dir).select("rec", F.posexplode("embedding").alias("i", "v")).select("rec", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


HANN9 = [x / sum(series.hann(9)) for x in series.hann(9)]
MIXED = f"q AS (SELECT rec, i, v * cos(2 * pi() * 700 / {FS} * i) AS re, v * sin(2 * pi() * 700 / {FS} * i) AS im FROM s)"


def hann9(x: str) -> str:
    """Nine samples of x under a Hann window, zeros beyond the ends."""
    near = [f"lag({x}, {4 - k}, 0) OVER w" if k < 4 else x if k == 4 else f"lead({x}, {k - 4}, 0) OVER w" for k in range(9)]
    return " + ".join(f"{c!r}::DOUBLE * {n}" for c, n in zip(HANN9, near, strict=True))


@query(f"""WITH {BLOCKS}, {MIXED}, m AS (SELECT rec, i, sqrt(pow({hann9("re")}, 2) + pow({hann9("im")}, 2)) AS mag FROM q WINDOW w AS (PARTITION BY rec ORDER BY i))
SELECT rec, i, round(mag / (max(mag) OVER (PARTITION BY rec) + 1e-8), 6) AS env FROM m""")
def coherent_hann_env(spark, sf_dir):
    return rounded(whole.coherent_hann(block_samples(spark, sf_dir), 700.0, FS, 9), "env").select("rec", "i", "env")


@query(f"""WITH {BLOCKS}, q AS (SELECT rec, i, v * cos(2 * pi() * 700 / {FS} * (i % 16)) AS re, v * sin(2 * pi() * 700 / {FS} * (i % 16)) AS im FROM s)
SELECT rec, i, round(sqrt(pow(sum(re) OVER w, 2) + pow(sum(im) OVER w, 2)), 6) AS mag FROM q WINDOW w AS (PARTITION BY rec ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def ring_magnitude(spark, sf_dir):
    return rounded(whole.ring_magnitude(block_samples(spark, sf_dir), 700.0, FS, 16), "mag").select("rec", "i", "mag")


@query(f"""WITH {BLOCKS}, f AS (SELECT unnest(range(9, 33)) AS b), d AS (SELECT rec, b, pow(sum(v * cos(2 * pi() * b * i / 64)), 2) + pow(sum(v * sin(2 * pi() * b * i / 64)), 2) AS p FROM s, f GROUP BY rec, b),
n AS (SELECT rec, 10 - CASE WHEN median(p) < 1e-10 THEN 30 ELSE 10 * log10(max(p) / median(p)) END AS need FROM d GROUP BY rec),
u AS (SELECT rec, CASE WHEN need <= 0 THEN 50 ELSE floor(least(greatest(pow(pow(10, need / 10), 2) / 800 * 1000, 50), 200) / 10) * 10 END AS ms FROM n),
c AS (SELECT rec, i, sum(v * cos(2 * pi() * 100 / 800 * i)) OVER w AS re, sum(v * sin(2 * pi() * 100 / 800 * i)) OVER w AS im FROM s WINDOW w AS (PARTITION BY rec ORDER BY i ROWS UNBOUNDED PRECEDING)),
m AS (SELECT c.rec, c.i, ms, sqrt(pow(c.re - coalesce(b.re, 0), 2) + pow(c.im - coalesce(b.im, 0), 2)) / (ms * 0.8) AS mag FROM c JOIN u ON u.rec = c.rec LEFT JOIN c b ON b.rec = c.rec AND b.i = c.i - (ms * 0.8)::INT)
SELECT rec, i, round(mag / (max(mag) OVER (PARTITION BY rec) + 1e-8), 6) AS env, ms::DOUBLE AS used_ms FROM m""")
def adaptive_env(spark, sf_dir):
    return rounded(whole.adaptive_envelope(vectors(spark, sf_dir), "rec", "embedding", 800, 100.0), "env")


@query()
def smooth_carrier(spark, sf_dir):
    return rounded(whole.smooth_carrier(vectors(spark, sf_dir), "rec", "embedding", FS, 700.0), "freq", "re")


# --- gap classes by kernels, recordings, streams --------------------------------------------------------------------------


@query()
def viterbi_gaps(spark, sf_dir):
    marks, spaces = marks_and_spaces(spark, sf_dir)
    return timing.kernel_gaps(spaces, timing.quartile_dit(marks), "viterbi")


@query()
def weighted_gaps(spark, sf_dir):
    marks, spaces = marks_and_spaces(spark, sf_dir)
    return timing.kernel_gaps(spaces, timing.quartile_dit(marks), "weighted")


@query()
def hybrid_gaps(spark, sf_dir):
    marks, spaces = marks_and_spaces(spark, sf_dir)
    return timing.kernel_gaps(spaces, timing.quartile_dit(marks), "hybrid")


def recordings(spark, sf_dir):
    """Nation names as keyed audio."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("CQ DE "), F.replace("n_name", F.lit("_"), F.lit(" "))).alias("t"))
    return audio.synthesized(n.repartition(8), "id", "t", 8000, 700.0, 25.0)


@query()
def decode_recordings(spark, sf_dir):
    return rounded(decode.decode(recordings(spark, sf_dir)), "score", "freq", "freq_initial", "snr_db", places=4)


NATION_TEXT = "SELECT n_nationkey::VARCHAR AS rec_id, 'CQ DE ' || replace(n_name, '_', ' ') AS text FROM nation"


@query(NATION_TEXT)
def decoded_text(spark, sf_dir):
    """What decoding reads from keyed audio, before repair: the text that was keyed."""
    return decode.decode(recordings(spark, sf_dir), correct=False).select("rec_id", F.trim("text").alias("text"))


@query(NATION_TEXT)
def legacy_text(spark, sf_dir):
    """The same by the older decoder."""
    return decode.legacy(recordings(spark, sf_dir)).select("rec_id", F.trim("text").alias("text"))


@query("SELECT n_nationkey::VARCHAR AS rec_id, (2000 + n_nationkey) || ',' || (2001 + n_nationkey) AS serials FROM nation")
def contest_serials(spark, sf_dir):
    """Serials of exchanges heard in windows so close that the last one holds their end."""
    return contest.transcript(contest_audio(spark, sf_dir), 700.0, 16.0, 7.0).select("rec_id", F.array_join("serials", ",").alias("serials"))


@query()
def decode_hypotheses(spark, sf_dir):
    return rounded(decode.hypotheses(recordings(spark, sf_dir), 700.0), "score", "snr_db", "dit", "dah", "wpm", "duty_cycle", places=4)


@query()
def stream_hits(spark, sf_dir):
    return rounded(channels.decode_batch(channels.chunked(recordings(spark, sf_dir), 4000)), "score", "wpm", places=4)


# --- event time -----------------------------------------------------------------------------------------------------------


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("""WITH b AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events), x AS (SELECT event_type, value, b - INTERVAL 30 MINUTE * k AS start FROM b, range(2) r(k))
SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL""")
def sliding(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), "n", "total")
