"""Small default dictionaries for text repair; every repair takes its own as a parameter."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .codes import CODE_OF

#: Call signs as the Radio Regulations form them: a prefix of two letters, a letter and a digit in either order, or one of the
#: letters that are allotted alone; a digit; and up to four letters.
PREFIX = r"(?:[A-Z]{2}|[A-Z][0-9]|[0-9][A-Z]|[BFGIKMNRW])"
CALL_PATTERN = rf"^{PREFIX}[0-9][A-Z]{{1,4}}$"
CALL = re.compile(CALL_PATTERN)
CUT_REPORT = re.compile(r"^(?:[15E]NN|[1-5]NN)$")
REPORT = re.compile(r"^[1-5][1-9][1-9]$")
USUAL_REPORTS = ("599", "579", "559", "449", "339")
PROSIGNS = ("<AR>", "<SK>", "<KN>")
EDGE = ".,;:!?="

#: Abbreviations of operating practice, by what they are for.
_PROCEDURE = "CQ DE K KN AR AS BK BT SK CL R C RPT AGN CFM NIL"
_PEOPLE = "OM OP YL XYL OB"
_COURTESY = "HI GA GB GD GE GM GN CUL CUAGN PSE TKS TNX TU VY FB HPE 73 88"
_TALK = "ABT ANT BCNU CPY DR DX ES FER GUD HR HV HW HAM INFO LID MNI MSG MY NR NW PWR RCVR RIG RPRT RST RX SIG SIGS SKED STN SUM TEMP TMW TX UR VIA WKD WKG WL WX XCVR XMTR"
ABBREVIATIONS = frozenset(f"{_PROCEDURE} {_PEOPLE} {_COURTESY} {_TALK}".split())
#: The operating signals QRA to QSZ, and of those from QTA on the four that amateurs use.
Q_CODES = frozenset([f"Q{a}{b}" for a in "RS" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"] + ["QTC", "QTH", "QTR", "QTX"])
WORDS = frozenset(
    "THE AND FOR YOU ARE NOT BUT ALL ANY CAN HAD HER WAS ONE OUR OUT DAY GET HAS HIM HIS HOW MAN NEW NOW OLD SEE TWO WAY WHO BOY DID ITS LET PUT SAY SHE TOO USE FIRST "
    "THIS THAT WITH HAVE FROM THEY KNOW WANT BEEN GOOD MUCH SOME TIME VERY WHEN COME HERE JUST LIKE LONG MAKE MANY MORE ONLY OVER SUCH TAKE THAN THEM WELL WERE NAME TEST CALL BAND "
    "ABOUT AFTER AGAIN COULD EVERY FOUND GREAT HOUSE LARGE LIGHT MIGHT NEVER OTHER PLACE POINT RADIO RIGHT SMALL SOUND STILL THEIR THERE THESE THING THINK THREE UNDER WATER WHERE "
    "WHICH WORLD WOULD WRITE SIGNAL REPORT STATION ANTENNA WEATHER POWER SUPPLY KEYER BULLETIN FOLLOWS WARNING CONDITIONS TO OF IN IS IT ON AT BE DO GO HE IF ME NO SO UP WE AM AN AS BY OR US I A".split()
)
KNOWN_CALLS = ("W1AW", "K3EST", "N0CALL", "JA1ABC", "VE3XYZ")
WORD_FIXES = {"TNK": "TNX", "TNKS": "TNX", "THX": "TNX", "QSI": "QSL", "QRA?": "QRZ?", "ANTENA": "ANTENNA", "WEATER": "WEATHER", "REPROT": "REPORT", "RADOI": "RADIO", "PSS": "PSE", "FBB": "FB"}
MERGED_FIXES = {"TNXFER": "TNX FER", "CQCQ": "CQ CQ", "CQDE": "CQ DE", "URRST": "UR RST", "TNXQSO": "TNX QSO", "DEW1AW": "DE W1AW", "NAMEIS": "NAME IS"}


def lookalikes() -> tuple[tuple[str, str], ...]:
    """(sign, the sign it may stand for): a letter for the digit that has one mark more at an end, a digit for its neighbours, which differ in one mark, and O and 0, which are written alike."""
    letters = {code: c for c, code in CODE_OF.items() if len(c) == 1 and c.isalpha()}
    out = [("O", "0"), ("0", "O")]
    for d in "0123456789":
        out += [(letters[part], d) for part in (CODE_OF[d][:-1], CODE_OF[d][1:]) if part in letters]
        out += [(d, str((int(d) + step) % 10)) for step in (1, 9)]
    return tuple(dict.fromkeys(out))


LOOKALIKES = lookalikes()
GARBLE = (("TTHE", "THE"), ("ANDD", "AND"), ("QQ", "Q"))


@dataclass(frozen=True)
class Vocabulary:
    """What a repair knows."""

    words: frozenset = WORDS
    abbreviations: frozenset = ABBREVIATIONS
    q_codes: frozenset = Q_CODES
    known_calls: tuple = KNOWN_CALLS
    word_fixes: dict = field(default_factory=lambda: dict(WORD_FIXES))
    merged: dict = field(default_factory=lambda: dict(MERGED_FIXES))
    garble: tuple = GARBLE

    @property
    def valid(self) -> frozenset:
        return self.words | self.abbreviations | self.q_codes
