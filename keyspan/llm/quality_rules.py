"""Quality rules in DataFrame expressions only: fixed limits, then robust multivariate outliers.

Statistics of a text are counted inside its row.  Transformed to a vector, they are compared with a
minimum-covariance-determinant estimate of their language and source: from medians and spreads, the
nearest three quarters of the rows are taken, their mean and covariance estimated, distances taken anew,
and so on (concentration steps, each of which lowers the determinant).  The estimate of a language and source
is drawn to that of its language, and this to that of all rows, by a weight of PRIOR rows, at every size.
Rows beyond a high chi-square cut of the final Mahalanobis distance are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, plain_words
from .tables import BROADCAST_ROWS, dropped, rows_of, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Share of rows in the estimate, steps, rows that the wider group's estimate counts as (five for each of its 5 means and 15 covariances), accuracy of quantiles.
CORE, STEPS, PRIOR, ACCURACY = 0.75, 4, 100, 10_000
#: Squared distance beyond which a row is rejected, after scaling: chi-square with 5 degrees of freedom, probability 1e-6; and the
#: normal quantile of that probability.
CUT, QUANTILE = 35.9, 4.7534
#: Median of chi-square with 5 degrees of freedom, to which the core's distances are scaled.
MEDIAN = 4.351
#: Least standard deviation of each entry of the vector.  Clean texts have no symbols and mostly no repeats, so their core has no
#: spread of its own there: beyond the cut by themselves are 3 % symbols, 3 repeated lines in 100 words, 23 % repeated words.
FLOORS = (0.02, 0.03, 0.06, 0.08, 0.10)
VECTOR = ("v1", "v2", "v3", "v4", "v5")


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that stand twice or more in the array.

    Window hashes with their place in the low bits are sorted as plain longs; neighbours with equal high bits are the only
    candidates, and those are settled by their words.
    """

    def of_words(w):
        bits = F.ceil(F.log2(F.size(w) + F.lit(2))).cast("int")
        return let(bits, lambda b: let(packed(w, b), lambda p: let(candidates(w, p, b), runs)))

    def packed(w, b):
        low = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
        return F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.slice(w, i, 3)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

    def candidates(w, p, b):
        high = lambda x: F.call_function("shiftright", x, b)
        near = F.filter(p, lambda x, i: (high(x) == high(F.get(p, i + 1))) | (F.coalesce(high(x) == high(F.get(p, i - 1)), F.lit(False))))
        place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1).cast("int")
        return F.sort_array(F.transform(near, lambda x: F.struct(F.array_join(F.slice(w, place(x), 3), " ").alias("text"), place(x).alias("at"))))

    def runs(c):
        same = lambda x, j: F.coalesce(F.get(c, j).text == x.text, F.lit(False))
        places = F.sort_array(F.transform(F.filter(c, lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x.at))
        step = lambda a, x: F.struct((a.n + 3 - F.greatest(F.lit(0), a.upto - x)).alias("n"), (x + 3).alias("upto"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), step, lambda a: a.n)

    return F.when(F.size(words) >= 3, of_words(words)).otherwise(F.lit(0))


def text_statistics(text) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text column; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = let(plain_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    return {
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "counts": counts,
    }


def with_vector(rows: DataFrame) -> DataFrame:
    """Adds v1..v5: log word length, roots of the symbol, repeated-line and repeated-word shares, log length."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return rows.withColumns({
        "v1": F.log(chars / n),
        "v2": F.sqrt(F.col("n_symbols") / chars),
        "v3": F.sqrt(F.least(F.lit(1.0), F.lit(5.0) * F.col("n_dup_lines") / n)),
        "v4": F.sqrt(F.col("n_repeat_words") / n),
        "v5": F.log(n),
    })


def distance(scale: str = "scale") -> Column:
    """Squared Mahalanobis distance of v1.. from m1.. by the Cholesky factor l11, l21, ..: forward substitution."""
    done: list[Column] = []
    for i, v in enumerate(VECTOR, 1):
        rest = F.col(v) - F.col(f"m{i}")
        for j, y in enumerate(done, 1):
            rest = rest - F.col(f"l{i}{j}") * y
        done.append(rest / F.col(f"l{i}{i}"))
    total = done[0] * done[0]
    for y in done[1:]:
        total = total + y * y
    return total / F.col(scale)


def factored(moments: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l of the covariances c, with the floors added to the diagonal, to one row a group."""
    out = moments
    for i in range(1, len(VECTOR) + 1):
        for j in range(1, i + 1):
            value = F.col(f"c{i}{j}") + (FLOORS[i - 1] ** 2 if i == j else 0.0)
            for k in range(1, j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}"))
    return out


def sized_hint(keys: int):
    """Broadcasts a table with a row a key if that many are few."""
    return F.broadcast if keys <= BROADCAST_ROWS else lambda df: df


def robust_estimates(rows: DataFrame, keys: int) -> DataFrame:
    """(key, n, m.., c.., scale, l..) of each of the `keys` keys of rows (key, v1..): the minimum-covariance-determinant estimate, written.

    Every step is two aggregates combined before the shuffle, and joins with one row a key.
    """
    p, small = range(1, len(VECTOR) + 1), sized_hint(keys)
    quarter = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.percentile_approx(v, [0.25, 0.5, 0.75], ACCURACY).alias(f"q{i}") for i, v in enumerate(VECTOR, 1)])
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i in p for j in range(1, i)]
    spread = [F.pow((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349, F.lit(2)).alias(f"c{i}{i}") for i in p]
    start = quarter.select("key", "n", *[F.get(f"q{i}", F.lit(1)).alias(f"m{i}") for i in p], *zero, *spread).withColumn("scale", F.lit(1.0))
    at = written(factored(start), "mcd")
    moments = [*[F.avg(v).alias(f"m{i}") for i, v in enumerate(VECTOR, 1)], *[F.covar_pop(VECTOR[i - 1], VECTOR[j - 1]).alias(f"c{i}{j}") for i in p for j in range(1, i + 1)]]
    for _ in range(STEPS):
        far = rows.join(small(at), "key").select("key", "n", *VECTOR, distance().alias("d"))
        limit = far.groupBy("key").agg(F.percentile_approx("d", CORE, ACCURACY).alias("limit"))
        core = far.join(small(limit), "key").where("d <= limit").groupBy("key").agg(F.first("n").alias("n"), *moments)
        new = written(factored(core.withColumn("scale", F.lit(1.0))), "mcd")
        dropped(at)
        at = new
    half = rows.join(small(at), "key").groupBy("key").agg(F.percentile_approx(distance(), 0.5, ACCURACY).alias("half"))
    # the core alone is too narrow: scaled so that the median distance is that of chi-square, never below 1
    out = written(at.drop("scale").join(half.select("key", F.greatest(F.col("half") / MEDIAN, F.lit(1.0)).alias("scale")), "key"), "estimates")
    dropped(at)
    return out


def blended(own: DataFrame, own_key: str, wide: DataFrame, wide_key: str, groups: DataFrame) -> DataFrame:
    """groups with the estimates of their own key drawn to those of their wider key: their rows beyond twice the dimension, which the
    least core of full rank takes up, against PRIOR.  `rows` is the number of rows that an estimate is as sure as."""
    columns = ["scale", *[f"m{i}" for i in range(1, len(VECTOR) + 1)], *[f"c{i}{j}" for i in range(1, len(VECTOR) + 1) for j in range(1, i + 1)]]
    a = own.select(F.col("key").alias(own_key), F.col("n").cast("double").alias("own_n"), *[F.col(c).alias(f"own_{c}") for c in columns])
    b = wide.select(F.col(wide_key), F.col("rows").alias("wide_rows"), *[F.col(c).alias(f"wide_{c}") for c in columns])
    free = F.greatest(F.col("own_n") - 2 * len(VECTOR), F.lit(0.0))
    share = free / (free + F.lit(PRIOR))
    value = lambda c: F.coalesce(share * F.col(f"own_{c}") + (1 - share) * F.col(f"wide_{c}"), F.col(f"wide_{c}"))
    rows = F.coalesce(1 / (share * share / F.col("own_n") + (1 - share) * (1 - share) / F.col("wide_rows")), F.col("wide_rows"))
    both = groups.join(a, own_key, "left").join(b, wide_key, "left")
    return both.select(*groups.columns, rows.alias("rows"), *[value(c).alias(c) for c in columns])


def cut_for(rows: Column) -> Column:
    """CUT for an estimate from so many rows: estimated from few, distances follow an F and not a chi-square distribution (Hardin
    and Rocke), whose quantile is taken by its cube root's normal form.  Tends to CUT; null where rows are too few for any cut."""
    p = len(VECTOR)
    a, z2 = 2 / (9 * p), QUANTILE * QUANTILE
    largest = (1 - a) + QUANTILE * a**0.5
    b = 2 / (9 * (CORE * rows - p + 1))
    x2, x1, x0 = (1 - b) * (1 - b) - z2 * b, (1 - a) * (1 - b), (1 - a) ** 2 - z2 * a
    root = (x1 + F.sqrt(x1 * x1 - x2 * x0)) / x2
    return F.when((CORE * rows - p + 1 > 0) & (x2 > 0), CUT * F.pow(root / largest, F.lit(3)))


def group_estimates(vectors: DataFrame) -> DataFrame:
    """(lang, source, scale, cut, m.., l..), written, of every language and source of vectors (lang, source, base_failed, v1..)."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    lang, both = F.concat(F.lit("l"), name("lang")), F.concat_ws("\x1f", F.concat(F.lit("s"), name("lang")), name("source"))
    groups = written(vectors.select("lang", "source", both.alias("both"), lang.alias("of_lang"), F.lit("all").alias("of_all")).distinct(), "groups")
    rows = vectors.where("not base_failed").select(F.explode(F.array(both, lang, F.lit("all"))).alias("key"), *VECTOR)
    at = robust_estimates(rows, 2 * rows_of(groups) + 1)
    languages = blended(at, "of_lang", at.select(F.col("key").alias("of_all"), F.col("n").cast("double").alias("rows"), "*"), "of_all", groups.select("of_lang", "of_all").distinct())
    out = factored(blended(at, "both", languages.drop("of_all"), "of_lang", groups)).withColumn("cut", cut_for(F.col("rows")))
    out = written(out.select("lang", "source", "scale", "cut", *[c for c in out.columns if c[0] in "ml" and c[1:].isdigit()]), "group-estimates")
    dropped(groups, at)
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, th, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) of every row.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows.  kept: neither that nor an outlier.
    Estimates are made from rows that pass the base limits; where no row of the table does, only the base limits count.  Null
    languages and sources are groups of their own, repeated rows stay.  The texts are read once; all else works on the numbers.
    """
    s = text_statistics(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), *[c.alias(n) for n, c in s.items()])
    rows = rows.select("id", "th", "lang", "source", "counts.n_words", "word_chars", "n_symbols", "n_dup_lines", "counts.n_repeat_words")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = written(with_vector(rows), "stats")
    at = group_estimates(rows)
    at = at.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    out = rows.join(sized_hint(rows_of(at))(at), same, "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > F.col("cut"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
