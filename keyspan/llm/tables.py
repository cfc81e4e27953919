"""Shared Spark plumbing of the operators: cut lineage, fixed-size filters, sized joins, components."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textscan import mix64

#: A side of a join is broadcast only if a count shows at most so many (narrow) rows.
BROADCAST_ROWS = 100_000
#: A key with more than this share of a table is hot: fewer keys than that can be.
HOT = 10_000
#: Bits of a membership filter for each key, and of all at most: 16 MB, whatever the input's size.
KEY_BITS, FILTER_BITS = 64, 1 << 27


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a session of one machine gets one of our own where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = f"/tmp/keyspan-shared-{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that written() made, once all that reads them is written itself."""
    for t in tables:
        remove_shared(t.sparkSession, t.shared_path)


def remove_shared(spark: SparkSession, path: str) -> None:
    """Removes a folder below the shared one by Spark's own file systems."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def tidied(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files and broadcasts of what is done with: it learns of them by a garbage collection, which else it asks for twice an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(taken, *names: str) -> list[str]:
    """Each name with underscores put after it until no column of `taken` has it, in whatever case."""
    used = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def rows_of(df: DataFrame) -> int:
    """Number of rows; of a written table it is counted once."""
    if not hasattr(df, "shared_rows"):
        df.shared_rows = df.count()
    return df.shared_rows


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most `limit` rows, else as it is.  For rows of numbers and short names."""
    return F.broadcast(df) if len(df.limit(limit + 1).select(F.lit(1)).take(limit + 1)) <= limit else df


def hot_keys(many: DataFrame, keys: list[str], least: int = 128) -> DataFrame | None:
    """(keys, spread_parts) of the keys with more than a HOT-th of all rows of a written table, and more than `least`: fewer than HOT rows."""
    most = max(least, rows_of(many) // HOT)
    counts = many.groupBy(*keys).count().where(F.col("count") > most)
    hot = written(counts.select(*keys, F.ceil(F.col("count") / most).cast("int").alias("spread_parts")), "hot")
    return F.broadcast(hot) if rows_of(hot) else None


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """many joined with one (a row a key): rows of a hot key get a number below its parts, and its row of `one` is repeated for each."""
    if hot is None:
        return many.join(one, keys, how)
    parts = F.coalesce("spread_parts", F.lit(1))
    part = F.pmod(F.xxhash64(*[c for c in many.columns if c not in keys]), parts).cast("int")
    left = many.join(hot, keys, "left").withColumn("spread_part", part).drop("spread_parts")
    right = one.join(hot, keys, "left").withColumn("spread_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("spread_parts")
    return left.join(right, [*keys, "spread_part"], how).drop("spread_part")


def hash_sample(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """The distinct rows of df, or about nine tenths of `most` chosen by a hash of columns: the same in every run.

    As no row stands twice, their number is binomial: `most` is some twenty spreads away at the sizes used, and a hot row counts once.
    """
    rows = written(df.distinct(), "sample")
    total = rows_of(rows)
    if total <= most:
        return rows
    limit = int(0.9 * most / total * (1 << 62))
    out = rows.where(F.shiftrightunsigned(F.xxhash64(*columns), 2) < F.lit(limit).cast("long"))
    out.shared_path = rows.shared_path
    return out


class Filter:
    """A Bloom filter of bounded size over int64 keys.  False hits only cost work: users re-check what passes."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        a = mix64(keys.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
        mask = np.uint64(bits - 1)
        return a & mask, (a >> np.uint64(32)) & mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for p in self.places(keys, 64 * len(self.words)):
            hit &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return hit

    @classmethod
    def over(cls, df: DataFrame, column: str):
        """Built on the executors and OR-ed by word; the driver gets at most FILTER_BITS / 64 words.  Returns a Spark broadcast.

        The keys are written out first, so that they are made once and their number sets the size.
        """
        keys_only = written(df.select(F.col(column).alias("k")), "keys")
        bits = min(FILTER_BITS, 1 << max(12, (KEY_BITS * rows_of(keys_only)).bit_length()))

        def marks(batches):
            for b in batches:
                keys = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                p = np.concatenate(cls.places(keys, bits))
                word, mask = (p >> np.uint64(6)).astype(np.int32), np.uint64(1) << (p & np.uint64(63))
                order = np.argsort(word, kind="stable")
                word, mask = word[order], mask[order]
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, int)
                if len(first):
                    yield pa.record_batch({"word": word[first], "mask": np.bitwise_or.reduceat(mask, first).view(np.int64)})

        rows = keys_only.mapInArrow(marks, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
        dropped(keys_only)
        return df.sparkSession.sparkContext.broadcast(cls(words))


def joined_edges(batches):
    """Batches (a, b) as one of (node, component): every node takes the smallest label of its edges' ends, again and again."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    a, b = (np.concatenate(c) for c in zip(*got, strict=True))
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before, label = label, label.copy()
        low = np.minimum(before[x], before[y])
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.record_batch({"node": nodes, "component": nodes[label]})


def components(edges: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """(node, component) of every node in edges (a, b) of longs: component is the smallest node reachable.

    Edges that a count shows to be `few` or less are joined in one task: a round over them would make thousands of tasks
    where there are many partitions, and what the driver holds grows with tasks.  More of them take alternating large-star
    and small-star steps; each is a min per node (combined before the shuffle) joined back, so no neighbourhood is
    gathered, and each round is written out, until all edges lead to a smallest node.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        kept = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return kept.where("a > b").distinct()

    def over(e: DataFrame) -> bool:
        """Whether every a stands once and is no b, so that a round would change nothing."""
        ends = e.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select("b", F.lit(0), F.lit(1)).toDF("u", "up", "down"))
        most = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max(F.col("up") + F.least("up", "down")))
        return (most.first()[0] or 0) <= 1

    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    if rows_of(e) <= few:
        return e.coalesce(1).mapInArrow(joined_edges, "node long, component long")
    while not over(e):
        last, e = e, written(star(star(e, True), False), "edges")
        dropped(last)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
