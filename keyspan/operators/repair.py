"""Text repair as DataFrame operators: the whole ordered chain by row, and single phases as expressions and joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import repair_text
from ..functions.columns import let
from ..functions.vocabulary import CALL_PATTERN, EDGE, PROSIGNS, USUAL_REPORTS, Vocabulary

RECORDS = pa.list_(pa.struct([("pos", pa.int32()), ("original", pa.string()), ("corrected", pa.string()), ("type", pa.string())]))
RECORDS_SQL = "array<struct<pos:int,original:string,corrected:string,type:string>>"


def semantic_correct(df: DataFrame, key: str, text: str, vocabulary: Vocabulary | None = None, phases=repair_text.PHASES) -> DataFrame:
    """df with `text` repaired and `corrections`: phases are sequential within a text, so each row is one call in an Arrow batch."""
    keep = [c for c in df.columns if c not in ("text", "corrections")]
    kinds = dict(df.dtypes)

    def fix(batches):
        for b in batches:
            done = [repair_text.repaired(t, vocabulary, phases) for t in b.column(keep.index(text)).to_pylist()]
            rows = [[{"pos": p, "original": o, "corrected": c, "type": k} for p, o, c, k in r] for _, r in done]
            yield pa.record_batch([*b.columns, pa.array([t for t, _ in done], pa.string()), pa.array(rows, RECORDS)], names=[*keep, "text", "corrections"])

    source = df.select(*keep) if text in keep else df.select(*keep, F.col(text).alias("_text"))
    if text not in keep:
        keep.append("_text")
        kinds["_text"] = "string"
        text = "_text"
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", text string, corrections {RECORDS_SQL}"
    out = source.mapInArrow(fix, schema)
    return out.drop("_text")


def correction_summary(corrected: DataFrame, key: str) -> DataFrame:
    """(texts, total, average) of a batch."""
    return corrected.agg(F.count("*").alias("texts"), F.sum(F.size("corrections")).alias("total"), F.avg(F.size("corrections")).alias("average"))


def without_prosigns(text: Column) -> Column:
    """Tokens lose prosigns that aren't all of them; emptied tokens go."""
    bare = lambda t: F.regexp_replace(t, "<(AR|SK|KN)>", "")
    fix = lambda t: F.when(t.isin(*PROSIGNS), t).otherwise(bare(t))
    return F.array_join(F.filter(F.transform(F.split(text, " "), fix), lambda t: t != ""), " ")


def cleaned_specials(text: Column) -> Column:
    """( to NG, a leading / to C, & dropped, ?PY? to CPY?."""
    fix = lambda t: let(F.replace(F.regexp_replace(F.replace(t, F.lit("("), F.lit("NG")), "^/", "C"), F.lit("&"), F.lit("")), lambda x: F.when(x == "?PY?", "CPY?").otherwise(x))
    return F.array_join(F.transform(F.split(text, " "), fix), " ")


def split_runons(text: Column) -> Column:
    """The ordered rewrites of exchanges that ran together, noise tokens dropped."""
    out = F.upper(text)
    for pattern, by in repair_text.RUN_ON:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    kept = F.filter(F.split(out, r"\s+"), lambda t: (t != "") & ~t.rlike(repair_text.NOISE.pattern))
    return F.array_join(kept, " ")


def detached(text: Column, vocabulary: Vocabulary | None = None) -> Column:
    """X= to X =, =X to = X, ?X to X for known X."""
    v = vocabulary or Vocabulary()
    known = F.array(*[F.lit(w) for w in sorted(v.abbreviations | v.q_codes | set(v.word_fixes))])
    words = F.array(*[F.lit(w) for w in sorted(v.words)])
    has = lambda a, x: F.array_contains(a, x)

    def fix(t):
        head, tail = F.upper(F.regexp_replace(t, "=$", "")), F.upper(F.regexp_replace(t, "^[=?]", ""))
        long = F.length(t) > 1
        return (
            F.when(long & t.endswith("=") & (has(known, head) | head.rlike("^[0-9]+$")), F.concat(head, F.lit(" =")))
            .when(long & t.startswith("=") & (has(known, tail) | has(words, tail)), F.concat(F.lit("= "), tail))
            .when(long & t.startswith("?") & (has(words, tail) | has(F.array(*[F.lit(w) for w in sorted(v.abbreviations)]), tail)), tail)
            .otherwise(t)
        )

    return F.array_join(F.transform(F.split(text, " "), fix), " ")


def call_shaped(token: Column) -> Column:
    return token.rlike(CALL_PATTERN) & ~token.rlike("^(?:[15E]NN|[1-5]NN)$")


def snapped(number: Column) -> Column:
    """A three-digit number to the usual report one digit away: the first place, the lowest digit."""
    out = number
    for j in (2, 1, 0):
        fits = sorted((r for r in USUAL_REPORTS), reverse=True)
        for r in fits:
            same = F.concat(F.substring(number, 1, j), F.lit(r[j]), F.substring(number, j + 2, 3)) == r
            out = F.when(same, F.lit(r)).otherwise(out)
    return F.when(number.isin(*USUAL_REPORTS) | ~number.rlike("^[0-9]{3}$"), number).otherwise(out)


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token, core): tokens with punctuation peeled off, upper-cased."""
    rows = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), " ")).alias("pos", "token")).where("token <> ''")
    edge = "[" + EDGE.replace("?", "\\?").replace(".", "\\.") + "]+"
    return rows.withColumn("core", F.upper(F.regexp_replace(F.regexp_replace("token", f"^{edge}", ""), f"{edge}$", "")))


def deletions(word: Column) -> Column:
    """A word and all words with one letter deleted: words one edit apart share one."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), cut))


def nearest_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, fixed): for each distinct word the nearest vocabulary word one edit away, the smaller of equals.

    Both sides are keyed by their deletions, so the join is on equality and levenshtein runs on few pairs.
    """
    a = words.select("word").distinct().select("word", F.explode(deletions(F.col("word"))).alias("d"))
    b = vocabulary.select(F.col("word").alias("known")).distinct().select("known", F.explode(deletions(F.col("known"))).alias("d"))
    near = a.join(b, "d").select("word", "known").distinct().where(F.levenshtein("word", "known") == 1)
    return near.groupBy("word").agg(F.min("known").alias("fixed"))
