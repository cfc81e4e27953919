"""Text to keying and back: encoding, element durations, symbol lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import decode_symbol, encode_symbol, keyable
from ..functions.columns import let

DIT_UNITS = {"dot": 1, "dash": 3, "in_char": 1, "char_gap": 3, "word_gap": 7}


def encode_text(text: Column) -> Column:
    """Codes joined by a space, words by ` / `, of the keyable part of a text; row-local."""
    words = F.filter(F.split(keyable(text), " "), lambda w: w != "")
    coded = F.transform(words, lambda w: F.array_join(F.transform(F.split(w, ""), encode_symbol), " "))
    return F.array_join(coded, " / ")


def decode_codes(codes: Column) -> Column:
    """Inverse of encode_text; unknown codes give ?."""
    words = F.filter(F.split(codes, " / "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, " "), decode_symbol), "")), " ")


def characters(df: DataFrame, rec: str, text: str) -> DataFrame:
    """(rec, pos, word_end, text_end, code) of each keyable character but spaces; pos from 1 counts spaces as well.

    Each character takes the next one with it while both stand in the row's array, so no row carries the text.
    """
    signs = F.filter(F.split(keyable(F.col(text)), ""), lambda c: c != "")
    pairs = let(signs, lambda a: F.transform(a, lambda c, i: F.struct(c.alias("ch"), F.get(a, i + 1).alias("nxt"))))
    rows = df.select(F.col(rec).alias("rec"), F.posexplode(pairs).alias("p", "x")).where("x.ch <> ' '")
    end = F.col("x.nxt").isNull()
    return rows.select("rec", (F.col("p") + 1).alias("pos"), F.coalesce(F.col("x.nxt") == " ", F.lit(False)).alias("word_end"), end.alias("text_end"), encode_symbol(F.col("x.ch")).alias("code"))


def keying(df: DataFrame, rec: str, text: str, wpm: float = 20.0, jitter: int = 0) -> DataFrame:
    """(rec, pos, elem, state, units, dur_ms): marks and spaces of keyed text, in order of (pos, elem, state desc).

    A dot is 1200 / wpm ms.  jitter > 0 varies durations by up to that many percent, from rec, pos and elem alone.
    """
    chars = characters(df, rec, text).select("*", F.posexplode(F.split("code", "")).alias("elem", "e")).where("e <> ''")
    last = F.col("elem") == F.length("code") - 1
    mark = F.when(F.col("e") == "-", 3).otherwise(1)
    space = F.when(~last, 1).when(F.col("text_end"), 0).when(F.col("word_end"), 7).otherwise(3)
    both = F.explode(F.array(F.struct(F.lit(1).alias("state"), mark.alias("units")), F.struct(F.lit(0).alias("state"), space.alias("units")))).alias("s")
    rows = chars.select("rec", "pos", "elem", both).select("rec", "pos", "elem", "s.state", "s.units").where("units > 0")
    vary = (F.pmod(F.col("rec") * 31 + F.col("pos") * 17 + F.col("elem") * 7 + F.col("state") * 5, F.lit(2 * jitter + 1)) - jitter) if jitter else F.lit(0)
    return rows.withColumn("dur_ms", F.col("units") * (100 + vary) * F.lit(1200.0 / wpm / 100.0))


def label_elements(segments: DataFrame, dit: float, ratio: float = 2.0, word: float = 5.0) -> DataFrame:
    """Adds label: dash above ratio dits; spaces in_char below ratio, word_gap from `word` dits on, else char_gap."""
    d = F.col("dur_ms") / F.lit(dit)
    mark = F.when(d > ratio, "dash").otherwise("dot")
    gap = F.when(d < ratio, "in_char").when(d < word, "char_gap").otherwise("word_gap")
    return segments.withColumn("label", F.when(F.col("state") == 1, mark).otherwise(gap))


def assemble(segments: DataFrame, order: list[str]) -> DataFrame:
    """(rec, text): labelled elements joined to codes, looked up, and joined to text, one group a recording."""
    part = F.when(F.col("label") == "dot", ".").when(F.col("label") == "dash", "-").when(F.col("label") == "char_gap", " ").when(F.col("label") == "word_gap", " / ").otherwise("")
    rows = segments.select("rec", F.struct(*order, (1 - F.col("state")).alias("then")).alias("at"), part.alias("part"))
    joined = rows.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return joined.select("rec", decode_codes(F.array_join(F.transform("parts", lambda x: x.part), "")).alias("text"))
