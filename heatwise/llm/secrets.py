"""Secrets in texts: an Aho-Corasick keyword pass, anchored patterns at its hits, checksums.

One pass of the automaton finds all keyword starts; each pattern is then tried only there
(``match`` at a position, never a search), left to right and without overlap for each kind,
which gives the spans that a whole search would.  Plain hex runs have no keyword; they are
found by their length.  Tokens that carry their own checksum (``github`` and ``npm``: six
base-62 digits of the CRC-32 of the thirty characters before) count only if it is right.

Positions are code points, ends exclusive.  Defined cases: a null text counts as empty and
has no spans; repeated rows are scanned alike; texts are scanned whole whatever their
length; rows are independent, so a key or source with many rows needs no care.
"""
from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
#: Patterns and least lengths.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_TAIL = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKENS = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
_TOKEN_BODY = re.compile(r"[0-9A-Za-z]{36}(?![0-9A-Za-z])")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20

Span = tuple[int, int, int]      # start, rank of the kind, end


def checksum(body: str) -> str:
    """The last six characters of a token body whose first thirty are ``body``."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _DIGITS[digit] + out
    return out


@cache
def _automaton():
    import ahocorasick
    found = ahocorasick.Automaton()
    for word in _ASSIGN_WORDS:
        for spelt in itertools.product(*({c.lower(), c.upper()} for c in word)):
            found.add_word("".join(spelt), ("assign", len(word)))
    found.add_word("AKIA", ("access", 4))
    for prefix, kind in _TOKENS.items():
        found.add_word(prefix, (kind, len(prefix)))
    found.make_automaton()
    return found


def spans(text: str) -> list[Span]:
    """All spans of one text, by start and then kind."""
    out: list[Span] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _automaton().iter(text):
        start, after = last + 1 - length, last + 1
        if start < done[kind]:
            continue
        if kind == "assign":
            hit = _ASSIGN_TAIL.match(text, after)
            if hit:
                done[kind] = hit.end()
                if hit.end(1) - hit.start(1) >= ASSIGN_VALUE:
                    out.append((start, 0, hit.end()))
        elif kind == "access":
            hit = _ACCESS.match(text, start)
            if hit:
                done[kind] = hit.end()
                if hit.end() - start >= ACCESS_LENGTH:
                    out.append((start, 1, hit.end()))
        else:
            hit = _TOKEN_BODY.match(text, after)
            if hit and checksum(text[after:after + 30]) == text[after + 30:after + 36]:
                done[kind] = hit.end()
                out.append((start, KINDS.index(kind), hit.end()))
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by ``[secret]``."""
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _texts(texts: pd.Series) -> list[str]:
    return ["" if t is None or t != t else t for t in texts]


@cache
def scan_udf():
    """struct(n_assign, n_access, n_hex, base_sha256, spans) of a text column."""
    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in _texts(texts):
                found = spans(text)
                base = [s for s in found if s[1] < len(BASE)]
                rows.append((*(sum(s[1] == k for s in base) for k in range(3)),
                             hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return scan


@cache
def redact_udf():
    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t, spans(t)) for t in _texts(texts)], dtype=object)
    return redact


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, counts of base spans, their digest, and all spans."""
    return (docs.select(*keep, scan_udf()(F.col(text_col).cast("string")).alias("__scan"))
            .select(*keep, "__scan.*"))


def redact(text: Column) -> Column:
    """A text column with its secrets replaced; null stays null."""
    return F.when(text.isNotNull(), redact_udf()(text))
