"""Token counts with a whole-token shortcut.

Offline (once a worker) every vocabulary string is put through the tokenizer's own merges: those that end as one token are
whole tokens.  A pre-token that is a whole token counts 1 without merging; only the rest is merged.  Pre-tokens are found by a
pattern over character classes, which are asked of the tokenizer's splitter for every code point, so they agree with it
whatever Unicode version each was built with.
"""

from __future__ import annotations

import contextlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most texts have no code points from here on; the short classes below it make the quicker pattern.
NEAR = 0x530
#: Code points asked about at once.
BLOCK = 1 << 12
#: Merged pre-tokens remembered by a worker at once.
MEMO = 300_000


def code_point_classes(splitter, low: int, high: int) -> dict[str, list[int]]:
    """letter, digit and space: the code points from low to high (but surrogates) that the splitter takes for one.

    A run that makes one piece with a letter before it is all letters, with a digit all digits, with ! all other marks; else
    its halves are asked about, and a single code point that joins none is space.
    """
    out: dict[str, list[int]] = {"letter": [], "digit": [], "space": [], "mark": []}
    todo = [range(at, min(at + BLOCK, high)) for at in range(low, high, BLOCK)]
    while todo:
        run = todo.pop()
        text = "".join(chr(c) for c in run if not 0xD800 <= c < 0xE000)
        kind = next((k for k, lead in (("mark", "!"), ("letter", "a"), ("digit", "1")) if len(splitter.pre_tokenize_str(lead + text)) == 1), None)
        if kind is None and len(text) > 1:
            todo += [run[: len(run) // 2], run[len(run) // 2 :]]
        elif text:
            out[kind or "space"] += map(ord, text)
    return {k: sorted(v) for k, v in out.items() if k != "mark"}


def ranges(points: list[int]) -> str:
    """Code points as ranges for a character set."""
    have = set(points)
    starts = [c for c in points if c - 1 not in have]
    ends = [c for c in points if c + 1 not in have]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


def pattern(splitter, high: int) -> re.Pattern:
    """Byte-level splitting of texts below `high`.  Contractions start with an apostrophe and runs of letters or digits don't, so the commoner runs are tried first."""
    letter, digit, space = (ranges(p) for p in code_point_classes(splitter, 0, high).values())
    return re.compile(f" ?[{letter}]+| ?[{digit}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, by rule: printable Latin-1 bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """Numbers of tokens of pre-tokens, merged at the first look-up; emptied when full, so memory is bounded."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece)
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n


class WholeTokenCounter:
    """Counts tokens of texts as the tokenizer file's library does, special tokens not added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        if self.library.normalizer is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        chars = byte_alphabet()
        self.stand_ins = {b: c for c, b in chars.items()}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.near, self.beyond = pattern(self.library.pre_tokenizer, NEAR), re.compile(f"[^\\x00-\\u{NEAR - 1:04x}]")
        merged = self.library.model.tokenize
        self.whole = set()
        for token in spec["model"]["vocab"]:
            if all(c in chars for c in token) and len(merged(token)) == 1:
                with contextlib.suppress(UnicodeDecodeError):  # part of a character: never a whole pre-token
                    self.whole.add(bytes(chars[c] for c in token).decode())
        self.memo = Memo(self.merge)

    @property
    def far(self) -> re.Pattern:
        """The pattern over all code points, made when a worker first needs it."""
        if not hasattr(self, "_far"):
            self._far = pattern(self.library.pre_tokenizer, 0x110000)
        return self._far

    def merge(self, piece: str) -> int:
        """Number of tokens that a pre-token ends as, by the model's merges."""
        return len(self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.stand_ins)))

    def count(self, text: str) -> int:
        total, whole, rest, at = 0, self.whole, self.memo.__getitem__, 0
        parts = [text]
        if self.cut is not None and (hits := list(self.cut.finditer(text))):
            parts = []
            for m in hits:
                parts.append(text[at : m.start()])
                at = m.end()
            parts.append(text[at:])
            total = len(hits)
        for part in parts:
            pieces = (self.far if self.beyond.search(part) else self.near).findall(part)
            left = [p for p in pieces if p not in whole]
            total += len(pieces) - len(left) + sum(map(rest, left))
        return total


@lru_cache(1)
def counter(path: str) -> WholeTokenCounter:
    return WholeTokenCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; a null text counts as empty, repeated rows stay, an empty table gives no rows.

    No shuffle: a narrow map over the scan.  `vocabulary` is a path every executor can open.
    """
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches):
        c = counter(vocabulary)
        for b in batches:
            n = np.fromiter((c.count(t or "") for t in b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n"))
    return narrow.mapInArrow(count, schema)
