"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Of every 9 consecutive 5-gram hashes (13 words) the smallest is a fingerprint, so two texts that share
13 words share one.  Document fingerprints meet those of the benchmark in a join; documents with a hit
are extended to the exact 13-word windows, compared as text, that cover their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import each_run, folded_words, let
from .tables import hinted, written

SPAN, K = 13, 5


def fingerprints(words: Column, span: int, k: int, shorter: list[int]) -> Column:
    """Winnowed k-gram hashes of runs of `span` words, and all hashes of the given shorter lengths."""
    none = F.array().cast("array<bigint>")
    grams = lambda w, n: F.coalesce(each_run(w, n, lambda i: F.xxhash64(F.slice(w, i, n))), none)
    keep = lambda h: F.coalesce(each_run(h, span - k + 1, lambda i: F.array_min(F.slice(h, i, span - k + 1))), none)
    return let(words, lambda w: F.array_distinct(F.concat(let(grams(w, k), keep), *[grams(w, n) for n in shorter])))


def windows(words: Column, lengths: list[int]) -> Column:
    """Structs (start, length, window) of all runs of the given lengths, start from 1."""
    none = F.array().cast("array<struct<start:int,length:int,window:string>>")
    runs = lambda w, n: F.coalesce(each_run(w, n, lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(w, i, n), " ").alias("window"))), none)
    return let(words, lambda w: F.concat(*[runs(w, n) for n in lengths]))


def merged(hits: Column) -> Column:
    """Disjoint spans (start, upto), upto being the word after, of a sorted array of runs (start, length)."""
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("upto"))
    fresh = lambda x: span(x.start, x.start + x.length)
    # the open span is carried beside the closed ones, so that a step touches one element
    step = lambda a, x: F.when(a.open.upto >= x.start, F.struct(a.done.alias("done"), span(a.open.start, F.greatest(a.open.upto, x.start + x.length)).alias("open"))).otherwise(
        F.struct(F.concat(a.done, F.array(a.open)).alias("done"), fresh(x).alias("open"))
    )
    start = F.struct(F.array().cast("array<struct<start:int,upto:int>>").alias("done"), fresh(F.get(hits, F.lit(0))).alias("open"))
    return F.aggregate(hits, start, step, lambda a: F.concat(a.done, F.array(a.open)))


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words in spans (start, upto), each with the separators before it; all else stays as it was."""
    apart = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

    def kept(words):
        last = F.size(spans)
        begin = lambda i: F.when(i == 0, 1).otherwise(F.get(spans, i - 1).upto)
        end = lambda i: F.when(i == last, F.size(words) + 1).otherwise(F.get(spans, i).start)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, begin(i), end(i) - begin(i)))), "")

    words = let(F.regexp_extract_all(text, F.lit(f"[{apart}]*[^{apart}]+"), F.lit(0)), kept)
    return F.concat(words, F.regexp_extract(text, f"([{apart}]*)$", 1))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, th, n_words, n_hit, items, spans) of every row; items are the ids (as strings, sorted) whose windows occur.

    spans are the runs of words hit, disjoint, as (start, upto) from 1; th is the text's hash.

    An item with fewer than `span` words, but not none, is one window; such lengths (at most span - 1) are looked up whole.
    Rows are told apart by id and text hash: repeated rows stay and get the same result, null ids are an id of their own.
    The benchmark side is broadcast only if counted to be small; hits are few rows of ids and numbers.
    """
    marked = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    items = written(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), folded_words(F.col(item_text)).alias("words")).where(F.size("words") > 0), "bench")
    shorter = sorted(r[0] for r in items.where(F.size("words") < span).select(F.size("words")).distinct().collect())
    full = F.size("words") >= span
    long_prints = items.where(full).select(F.explode(fingerprints(F.col("words"), span, k, [])).alias("print"))
    prints = long_prints.unionByName(items.where(~full).select(F.xxhash64("words").alias("print"))).distinct()
    spans = items.where(full).select("item", F.explode(windows(F.col("words"), [span])).alias("x")).select("item", "x.length", "x.window")
    spans = spans.unionByName(items.where(~full).select("item", F.size("words").alias("length"), F.array_join("words", " ").alias("window"))).distinct()

    # one pass over the texts: a row without fingerprint for each document, and a row for each fingerprint the benchmark has
    own = let(folded_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), fingerprints(w, span, k, shorter).alias("prints")))
    scanned = marked.select("id", "th", own.alias("o")).select("id", "th", F.col("o.n").alias("n"), F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.col("o.prints"))).alias("print"))
    seen = scanned.join(hinted(prints.withColumn("known", F.lit(True))), "print", "left").where("known or print is null")
    seen = written(seen.select("id", "th", "n", F.col("known").isNotNull().alias("hit")).groupBy("id", "th").agg(F.max("n").alias("n"), F.count_if(~F.col("hit")).alias("times"), F.max("hit").alias("hit")), "scanned")

    suspects = seen.where("hit").select(F.col("id").alias("sid"), F.col("th").alias("sth"))
    text = marked.join(hinted(suspects), F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left_semi")
    runs = text.select("id", "th", F.explode(windows(folded_words(F.col("text")), [*shorter, span])).alias("x")).select("id", "th", "x.*")
    found = runs.join(hinted(spans), ["length", "window"])
    per = found.groupBy("id", "th").agg(F.collect_set(F.struct("start", "length")).alias("runs"), F.collect_set("item").alias("items"))
    per = per.select(F.col("id").alias("sid"), F.col("th").alias("sth"), merged(F.array_sort("runs")).alias("spans"), F.array_sort("items").alias("items"))
    out = seen.join(hinted(per), F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.upto - x.start)
    none = F.array().cast("array<struct<start:int,upto:int>>")
    return out.select(F.col("id").alias(id_col), "th", F.col("n").cast("long").alias("n_words"), F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"))


def contaminated(share: int = 20) -> Column:
    """A document counts as contaminated if at least 1/share of its words are hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
