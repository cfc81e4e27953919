"""A corpus pipeline of five stages over documents; each stage's result is written as Parquet and is the next one's input.

quality rules -> one document of each near-duplicate group -> repeated passages cut -> benchmark text out -> sources mixed

Every stage takes documents with any further columns, whatever their names, and returns the columns of its input (the last one
adds `copy`).  Rows are told apart by doc_id and text: rows with one id and different texts are judged apart, rows that repeat
both share a verdict.  Null ids are an id of their own, null texts are empty ones, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm import decontaminate, quality_rules, shingle_join, source_mix, substring_dedup
from keyspan.llm.tables import dropped, fresh, hinted, hot_keys, spread_join, tidied, written

#: No SQL expresses the robust estimates of the first stage; tests hold every stage against brute force.
ORACLE_SQL = None


def keyed(rows: DataFrame, docs: DataFrame, th: Column | None = None) -> tuple[DataFrame, Column, list[str]]:
    """(rows with their first two columns, id and text hash, under names that docs doesn't have, the condition that joins docs to them, those names)."""
    rid, rth = fresh(docs.columns, "rid", "rth")
    out = rows.withColumnsRenamed({rows.columns[0]: rid, rows.columns[1]: rth})
    th = F.xxhash64(F.col("text")) if th is None else th
    return out, F.col("doc_id").eqNullSafe(F.col(rid)) & (th == F.col(rth)), [rid, rth]


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows of rejected (id, text hash)."""
    rows, same, _ = keyed(written(rejected.distinct(), "rejected"), docs)
    return docs.join(hinted(rows), same, "left_anti")


def retexted(docs: DataFrame, new: DataFrame, th: Column | None = None) -> DataFrame:
    """docs with the texts of new (id, text hash, text), a row a changed document; n_chars follows the text where there is such a column."""
    rows, same, names = keyed(new, docs, th)
    (text,) = fresh([*docs.columns, *names], "changed_text")
    joined = docs.join(rows.withColumnRenamed(rows.columns[2], text), same, "left")
    out = {"text": F.coalesce(text, "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Texts that are null, empty or short fail the base rule and go."""
    tidied(spark)
    judged = quality_rules.judge(docs.select("doc_id", "text", "lang", "source"))
    return without(docs, judged.where("not kept").select("doc_id", "th"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, of rows with one id that with the smallest text hash.

    Documents without words stay.  A null id comes after all others.  Of rows that repeat id and text one stays, the first by
    its columns as JSON.
    """
    tidied(spark)
    groups = shingle_join.grouped(docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64("text").alias("th")))
    order = F.struct(F.col("doc").isNull().alias("later"), F.col("doc"), F.col("th"))
    stays = groups.where("n > 0").groupBy("group").agg(F.min(order).alias("stays"), F.count("*").alias("rows")).where("rows > 1")
    stays = written(stays, "stays")
    copies = spread_join(groups, stays.select("group", "stays"), ["group"], hot_keys(groups, ["group"])).select("doc", "th", order.eqNullSafe(F.col("stays")).alias("first"))
    copies = written(copies.groupBy("doc", "th").agg(F.max("first").alias("first"), F.count("*").alias("rows")).where("not first or rows > 1"), "copies")
    dropped(groups, stays)
    id_ = F.col("doc").cast(docs.schema["doc_id"].dataType)
    left = without(docs, copies.where("not first").select(id_, "th"))
    again = copies.where("first").select(id_, "th")
    if not again.take(1):
        return left
    rows, same, _ = keyed(again, docs)
    one = left.join(hinted(rows), same, "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = one.groupBy(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2")).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return left.join(hinted(rows), same, "left_anti").unionByName(one)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of passages that stand in an earlier document cut out; a changed text has its words joined by one space.

    Rows with a null id keep their texts.  No row goes: a text that is all repeats gets empty.
    """
    tidied(spark)
    cut = substring_dedup.without_repeats(docs.select("doc_id", "text")).where("changed")
    cut = cut.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc"), "th", "kept").dropDuplicates(["doc", "th"])
    return retexted(docs, cut, F.xxhash64(F.col("text")).bitwiseAND(F.lit(0x7FFFFFFF)))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; of others with less benchmark text than that, the words hit are cut out and the rest stays."""
    tidied(spark)
    rows = decontaminate.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    hit = written(rows.where("n_hit > 0").select("doc_id", "th", "spans", decontaminate.contaminated().alias("gone")).distinct(), "hits")
    left = without(docs, hit.where("gone").select("doc_id", "th"))
    some, same, names = keyed(hit.where("not gone").select("doc_id", "th", "spans"), docs)
    (spans,) = fresh([*docs.columns, *names], "spans")
    some = hinted(some.withColumnRenamed("spans", spans))
    cut = docs.join(some, same).select(*names, decontaminate.without_spans(F.col("text"), F.col(spans)).alias("kept")).dropDuplicates(names)
    return retexted(left, written(cut, "cut"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, numbered from 0 in a last column `copy` (`copy_` where documents have one already).

    Rows with equal ids are taken equally often; documents without words stay once.
    """
    tidied(spark)
    goals = source_mix.thresholds(source_mix.sized(docs.select("doc_id", "text", "source")))
    key, times = fresh(docs.columns, "source_key", "times")
    goals = goals.withColumnRenamed("key", key)
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    copies = F.when(worded, source_mix.copies(source_mix.hashed(F.col("doc_id")))).otherwise(1)
    rows = docs.join(hinted(goals), source_mix.source_key(F.col("source")) == F.col(key)).withColumn(times, copies).where(F.col(times) > 0)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias(fresh(docs.columns, "copy")[0]))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmark),
    ("source mix", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
