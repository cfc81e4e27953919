"""Mixing sources to target weights by hash-threshold histograms.

Word counts are summed by source and hash bucket.  A running sum over a source's buckets shows in
which bucket its budget ends; only that boundary bucket is summed again by the next bits of the
hash, until the boundary is one hash value.  Documents are then taken by comparing their hash with
their source's threshold: nothing is sorted, and thresholds of a smaller budget lie inside those
of a larger one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, hinted, written
from .textscan import scan_words

LEVELS, BITS = 5, 12  # 60 bits of the hash, 4096 buckets at a time


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size): words of every whole text; null texts have none."""
    types = dict(docs.dtypes)

    def count(batches):
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for w in scan_words(b.column(2), lower=False):
                n[w.lo : w.hi] = w.counts
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n)], names=["id", "source", "size"])

    return docs.select(id_col, source_col, text_col).mapInArrow(count, f"id {types[id_col]}, source {types[source_col]}, size long")


def targets(sizes: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """One row a source: its size and target.

    Sources by code point, nulls last, get the weights in turn.  Targets proportional to weight are
    stopped at `cap` times the size and the rest is shared again; in order of cap over weight the
    stopped sources come first, so the final level is a running sum.  One row a source is handled.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("i"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("i", ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).withColumn("w", w)
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("w"), "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    per = per.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    free = F.min(F.when(F.col("most") > F.col("level") * F.col("w"), F.struct((F.col("most") / F.col("w")).alias("r"), F.col("key"), F.col("level"))))
    per = per.withColumn("free", free.over(Window.partitionBy()))
    target = F.when(F.col("free").isNull(), F.col("most")).otherwise(F.least("most", F.col("free.level") * F.col("w")))
    return per.select("key", "source_size", target.alias("target"))


def hashed(id_: Column) -> Column:
    """60 bits of an id's hash; a null id hashes as an empty string."""
    digest = F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A name for each source, null too."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, h, key, source) of every row, written."""
    rows = word_counts(docs, id_col, text_col, source_col)
    return written(rows.select("id", "size", hashed(F.col("id")).alias("h"), source_key(F.col("source")).alias("key"), "source"), "mix-rows")


def thresholds(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, mix_size, mix_target, mix_base, mix_limit, mix_nearer): a row a source of sized rows, for copies()."""
    goal = targets(rows, weights, share, cap)
    goal = goal.withColumn("base", F.when(F.col("target") > F.col("source_size"), 1).otherwise(0))
    goal = written(goal.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")), "mix-goals")
    # (key, prefix, below): the bucket in which the budget ends and the words in the buckets before it
    edge, made = goal.select("key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), []
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        here = F.shiftright("h", shift + BITS) == F.col("prefix") if level > 1 else F.lit(True)
        inside = rows.join(hinted(edge), "key").where(here)
        sums = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("below").alias("before"))
        run = F.sum("n").over(Window.partitionBy("key").orderBy("bucket"))
        sums = sums.withColumn("upto", F.col("before") + run).where("upto > budget")
        first = sums.groupBy("key").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("below"), "budget", "n"), "bucket").alias("e"))
        edge = written(first.select("key", "e.budget", F.col("e.bucket").alias("prefix"), "e.below", "e.n"), "mix-edge")
        made.append(edge)
    at = edge.select("key", F.col("prefix").alias("mix_limit"), ((F.col("below") + F.col("n") - F.col("budget")) < (F.col("budget") - F.col("below"))).alias("mix_nearer"))
    out = goal.select("key", F.col("source_size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("base").alias("mix_base")).join(at, "key", "left")
    out = written(out, "mix-thresholds")
    dropped(goal, *made)
    return out


def copies(h: Column) -> Column:
    """How often a row with hash h is taken, from the columns of its source's thresholds."""
    extra = (h < F.col("mix_limit")) | ((h == F.col("mix_limit")) & F.col("mix_nearer"))
    return F.col("mix_base") + F.coalesce(extra, F.lit(True)).cast("int")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row.

    A source below its target gives every row once and some a second time.  The hash is of the id,
    so reruns agree; rows with equal ids are taken or left together, and of the boundary hash value
    the nearer side is chosen.  Null ids hash as an empty string, a null source is a source of its own,
    sources without words have target 0, an empty table gives no rows.
    """
    rows = sized(docs, id_col, text_col, source_col)
    out = rows.join(hinted(thresholds(rows, weights, share, cap)), "key").withColumn("copies", copies(F.col("h")))
    return out.select(F.col("id").alias(id_col), "size", F.col("mix_size").alias("source_size"), F.col("mix_target").alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))
