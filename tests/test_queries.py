"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import glob
import os

import duckdb
import pytest

from keyspan.functions.vocabulary import WORDS as KNOWN_WORDS
from keyspan.functions.vocabulary import Vocabulary
from keyspan.operators import keying
from keyspan.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = lambda v: "NULL" if v is None else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    else:
        assert got


def test_word_break_takes_whole_turns(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id * 1000 + turn AS rec", "text")
    known = {r.rec: [w for w in r.text.split(" ") if w in KNOWN_WORDS] for r in turns.select("rec", keying.keyable(turns.text).alias("text")).collect() if r.text}
    got = {r.rec: r for r in QUERIES["word_break"](spark, sf_dir).collect()}
    assert {i: r.raw for i, r in got.items()} == {i: "".join(w) for i, w in known.items() if w}
    long = [i for i, w in known.items() if len(w) > 12]
    for i in long:
        letters = got[i].raw
        for bad, good in Vocabulary().garble:
            letters = letters.replace(bad, good)
        assert " " in got[i].text and got[i].text.replace(" ", "") == letters
    assert long
