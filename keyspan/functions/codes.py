"""The international Morse code and small token tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code of ITU-R M.1677-1 with common punctuation and three prosigns.  The code that ( shares with
# the prosign KN stands for the prosign.
LETTERS = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --..".split(), strict=True))
DIGITS = {str(d): "".join("." if 0 < (d - i) % 10 <= 5 and d else "-" for i in range(5)) for d in range(10)}
PUNCTUATION = dict(zip(".,?'!/):;=+-_\"$@&", ".-.-.- --..-- ..--.. .----. -.-.-- -..-. -.--.- ---... -.-.-. -...- .-.-. -....- ..--.- .-..-. ...-..- .--.-. .-...".split(), strict=True))
PROSIGNS = {"<AR>": ".-.-", "<SK>": "...-.", "<KN>": "-.--."}

CODE_OF = LETTERS | DIGITS | PUNCTUATION | PROSIGNS
SYMBOL_OF = {code: symbol for symbol, code in CODE_OF.items()}

#: Tokens that speak for readable traffic: procedure, what stations tell each other, and the plainest words of talk.
PLAUSIBLE = tuple(
    # calling and handing over
    "CQ DE TEST QRZ PSE CALL OVER "
    # reports and equipment
    "RST UR SIG ANT RIG PWR WATTS DIPOLE VERT YAGI "
    # courtesies
    "TNX TU HPE GD GM GE DR FB GL CUAGN "
    # the station and its place
    "NAME OP QTH NR WX TEMP RAIN SUNNY "
    # operating signals in use on the bands
    "QSO QSL QRM QSB QRP "
    # talk
    "THE AND IS HERE MY IN WITH FOR FROM TO ON AT IT HAVE GOOD VERY WORKING TODAY YEARS STATION".split()
)


def code_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def encode_symbol(symbol) -> Column:
    """Code of a symbol; null for symbols without one."""
    return F.try_element_at(code_map(CODE_OF), F.col(symbol) if isinstance(symbol, str) else symbol)


def decode_symbol(code) -> Column:
    """Symbol of a code, `?` for any other string: only exact codes are looked up."""
    return F.coalesce(F.try_element_at(code_map(SYMBOL_OF), F.col(code) if isinstance(code, str) else code), F.lit("?"))


def keyable(text) -> Column:
    """Upper-case ASCII letters, digits and single spaces of a text."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9 \\n]", "")
    return F.upper(F.trim(F.regexp_replace(plain, "[ \\n]+", " ")))
