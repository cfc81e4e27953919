import pytest
from pyspark.sql import functions as F

from keyspan.functions import repair_text as r
from keyspan.functions.vocabulary import Vocabulary
from keyspan.operators import repair

V = Vocabulary()
CASES = [
    (r.spurious_prosigns, "FOL<AR>OWS <SK> <AR><SK> K", "FOLOWS <SK> K"),
    (r.special_chars, "WARNI( /Q A&B ?PY?", "WARNING CQ AB CPY?"),
    (r.contest_runon, "yo4aac5nn2169 R5NN EEEI 5NNT83 TUW1AW", "YO4AAC 5NN 2169 R 5NN 5NN T83 TU W1AW"),
    (r.merged_words, "THEFIRST CQCQ, FORYOUAND TEST5", "THE FIRST CQ CQ, FOR YOU AND TEST 5"),
    (r.merged_calls, "W1AWK3EST W1AWTEST", "W1AW K3EST W1AW TEST"),
    (r.detached_prosigns, "AGN= =TNX ?FOLLOWS X=", "AGN = = TNX FOLLOWS X="),
    (r.common_words, "TNK, ANTENA", "TNX, ANTENNA"),
    (r.fuzzy_words, "STATIOM RUNNING WATER", "STATION RUNNING WATER"),
    (r.qso_context, "CQ THE DE W1AW", "CQ TEST DE W1AW K"),
    (r.qso_context, "FB QSK KE W1AW UR C? =", "FB QSO DE W1AW = UR CQ BT"),
    (r.qso_context, "TEST 103 ? TNX W1AW 1 NAME 599 599 N N ? TNX", "TEST 123 = TNX W1AW = NAME 599 599 NJ NJ = TNX"),
    (r.rst_context, "UR RSA 579 590 589", "UR RST 579 599 559"),
    (r.duplicate_calls, "W1AW W1AV DE W1AW", "W1AW W1AW DE W1AW"),
    (r.token_cascade, "wx=emg 59?9 tnx QSM stationx", None),
]


@pytest.mark.parametrize("phase, text, want", CASES)
def test_phase(phase, text, want):
    out, records = phase(text.split(" "), V)
    if want is not None:
        assert " ".join(out) == want
    assert records


def test_edit_distance_and_ties():
    assert [r.edit_distance(a, b) for a, b in (("CQ", "CQ"), ("CQ", "CK"), ("", "ABC"), ("KITTEN", "SITTING"))] == [0, 1, 3, 3]
    assert r.nearest("CAT", {"CAR", "CAB", "BAT"}, 1) == (1, "BAT")
    assert r.snapped_report("589") == "559" and r.snapped_report("599") == "599"


def test_chain_is_stable():
    once, records = r.repaired("CQ CQ DEW1AW W1AV TNXFER CAL= K")
    assert records and "W1AV" not in once
    assert r.repaired("")[0] == ""


def test_stitching():
    assert r.stitched("A B C D", "B C D E") == "A B C D E"
    assert r.stitched("ONE TWO THREE FOUR", "ONE TWO THREX FOUR FIVE") == "ONE TWO THREE FOUR FIVE"
    assert r.stitched("A B", "") == "A B" and r.stitched("", "C") == "C"
    assert r.transcript("CQ DE W1", "W1AW") == "CQ DE W1AW" and r.transcript("ABC", "B") == "ABC"


def test_expressions_agree_with_phases(spark):
    texts = ["FOL<AR>OWS <SK> <AR><SK> K", "WARNI( /Q A&B ?PY?", "AGN= =TNX ?FOLLOWS X= 12=", "YO4AAC5NN2169 R5NN EEEI 5NNT83 TUW1AW DEK3EST", "", "A"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = df.select("t", repair.without_prosigns(F.col("t")).alias("a"), repair.cleaned_specials(F.col("t")).alias("b"), repair.detached(F.col("t")).alias("c"), repair.split_runons(F.col("t")).alias("d")).collect()
    for row in rows:
        t = row.t.split(" ")
        assert row.a == " ".join(r.spurious_prosigns(t, V)[0])
        assert row.b == " ".join(r.special_chars(t, V)[0])
        assert row.c == " ".join(r.detached_prosigns(t, V)[0])
        assert row.d == " ".join(r.contest_runon(t, V)[0])
    nums = spark.range(0, 1000).select(F.format_string("%03d", "id").alias("n")).select("n", repair.snapped(F.col("n")).alias("s")).collect()
    assert all(x.s == r.snapped_report(x.n) for x in nums)


def test_corrected_frame(spark):
    df = spark.createDataFrame([(1, "UR RSA 579"), (2, None), (3, "TNK")], "id int, raw string")
    out = {x.id: x for x in repair.semantic_correct(df, "id", "raw").collect()}
    assert out[1].text == "UR RST 579" and out[1].corrections[0].type == "rst_context" and out[2].text == "" and out[3].text == "TNX"
    s = repair.correction_summary(repair.semantic_correct(df, "id", "raw"), "id").first()
    assert s.texts == 3 and s.total >= 2


def test_nearest_words_join(spark):
    words = spark.createDataFrame([("STATIOM",), ("CAT",), ("ZZZZZ",), ("BAND",)], "word string")
    vocab = spark.createDataFrame([(w,) for w in ("STATION", "CAR", "BAT", "BANDS", "LAND")], "word string")
    assert {x.word: x.fixed for x in repair.nearest_words(words, vocab).collect()} == {"STATIOM": "STATION", "CAT": "BAT", "BAND": "BANDS"}
