"""Personal data in texts: an Aho-Corasick pass for anchors, local parsers at each anchor.

One pass of the automaton finds the anchors: at-signs, ``+``, digits, ``://`` and account cue
words.  From an anchor a parser grows the span to its boundaries with plain character classes,
left or right, and validates what it holds:

* ``email``  at-sign: local part to the left, dotted domain to the right;
* ``ip``     digit: four dotted numbers, each at most 255;
* ``card``   digit: 16 to 19 digits with single blanks or hyphens between, Luhn sum right;
* ``phone``  plus sign: 8 to 15 digits with blanks, dots, brackets and hyphens between;
* ``handle`` at-sign behind no word character: a name of 3 to 30 letters, digits and ``_``;
* ``userinfo`` scheme: what stands before the at-sign of a URL's authority;
* ``iban``   cue: country, check digits and account, remainder modulo 97 right;
* ``account`` cue: 6 to 17 digits, with ``no``, ``nr``, ``number`` or marks between.

The first four are the base kinds; of each the spans are those of a leftmost, non-overlapping
search, and what fails validation is dropped without a second try inside it.  A span of
another kind counts only if it overlaps no base span and no earlier one of its own kind.
Every parser goes forward from where its kind last ended, so work is linear in the text.

Positions are code points, ends exclusive.  Defined cases: a null text counts as empty and has
no spans; repeated rows are scanned alike; whole texts are scanned whatever their length; an
empty table gives no rows; rows are independent, so a source with many rows needs no care.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "handle", "userinfo", "iban", "account")
BASE = KINDS[:4]
#: Character classes, patterns and limits of the kinds.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9]+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_])")
_AUTHORITY = re.compile(r"[^\x00-\x20/?#\\\"'<>]+")
_IBAN = re.compile(r"[\x20:=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"\x20*(?:number|no\.?|nr\.?)?[\x20:=#]{0,4}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9A-Za-z]|[\x20-][0-9])",
                      re.IGNORECASE)
_CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "kontonummer": "account",
         "compte": "account", "cuenta": "account"}
OCTET, CARD_DIGITS, PHONE_DIGITS = 255, (16, 19), (8, 15)

Span = tuple[int, int, int]      # rank of the kind, start, end


def luhn(digits: str) -> bool:
    """Whether the sum of the digits, every second from the right doubled, ends in zero."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48 << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _small(number: str) -> bool:
    bare = number.lstrip("0")
    return len(bare) <= 3 and int(bare or 0) <= OCTET


@cache
def _automaton():
    import ahocorasick
    found = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *"0123456789"):
        found.add_word(mark, ("digit" if mark.isdigit() else mark, len(mark)))
    for cue, kind in _CUES.items():
        for spelt in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(spelt, (kind, len(spelt)))
    found.make_automaton()
    return found


class _Text:
    """One text, its spans so far and, for each kind, where its last match ended."""

    def __init__(self, text: str):
        self.text, self.base, self.more = text, [], []
        self.done = dict.fromkeys(KINDS, 0)
        self.barrier = 0                       # behind the last at-sign: no local part crosses it

    def _base(self, kind: str, start: int, end: int, valid: bool) -> None:
        self.done[kind] = end
        if valid:
            self.base.append((KINDS.index(kind), start, end))

    def _more(self, kind: str, start: int, end: int) -> None:
        if start >= self.done[kind]:
            self.done[kind] = end
            self.more.append((KINDS.index(kind), start, end))

    def digit(self, at: int, _: int) -> None:
        text = self.text
        if at >= self.done["ip"]:
            hit = _QUAD.match(text, at)
            if hit:
                self._base("ip", at, hit.end(), all(map(_small, hit.groups())))
            else:
                self.done["ip"] = _NUMBER.match(text, at).end()
        if at >= self.done["card"]:
            hit = _DIGITS.match(text, at)
            if hit:
                bare = hit[0].replace(" ", "").replace("-", "")
                self._base("card", at, hit.end(), CARD_DIGITS[0] <= len(bare) <= CARD_DIGITS[1] and luhn(bare))

    def at_sign(self, at: int, after: int) -> None:
        text, low = self.text, max(self.barrier, self.done["email"])
        self.barrier = after
        before = text[low:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            hit = _DOMAIN.match(text, after)
            if hit:
                return self._base("email", at - local, hit.end(), True)
        if not (at and (text[at - 1].isalnum() or text[at - 1] in "_.@/")):
            hit = _NAME.match(text, after)
            if hit:
                self._more("handle", at, hit.end())

    def plus(self, at: int, _: int) -> None:
        if at >= self.done["phone"]:
            hit = _DIAL.match(self.text, at)
            if hit:
                n = sum(map(hit[0].count, "0123456789"))
                self._base("phone", at, hit.end(), PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1])

    def scheme(self, at: int, after: int) -> None:
        if after < self.done["userinfo"] or not (at and self.text[at - 1].isalnum()):
            return
        hit = _AUTHORITY.match(self.text, after)
        user = hit[0].rfind("@") if hit else -1
        if user > 0:
            self._more("userinfo", after, after + user)

    def iban(self, _: int, after: int) -> None:
        hit = _IBAN.match(self.text, after)
        if hit and iban_valid(hit[1].replace(" ", "")):
            self._more("iban", hit.start(1), hit.end(1))

    def account(self, _: int, after: int) -> None:
        hit = _ACCOUNT.match(self.text, after)
        if hit:
            self._more("account", hit.start(1), hit.end(1))


_PARSERS = {"digit": _Text.digit, "@": _Text.at_sign, "+": _Text.plus, "://": _Text.scheme,
            "iban": _Text.iban, "account": _Text.account}


def spans(text: str) -> list[Span]:
    """All spans of one text, by kind and then start."""
    seen = _Text(text)
    for last, (kind, length) in _automaton().iter(text):
        _PARSERS[kind](seen, last + 1 - length, last + 1)
    if seen.more:
        merged: list[tuple[int, int]] = []           # base spans of all kinds as disjoint runs
        for a, b in sorted((a, b) for _, a, b in seen.base):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        ends = [b for _, b in merged]

        def free(a: int, b: int) -> bool:
            i = bisect_left(ends, a + 1)             # first run that ends behind the start
            return i == len(merged) or merged[i][0] >= b
        seen.more = [s for s in seen.more if free(s[1], s[2])]
    return sorted(seen.base + seen.more)


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the first span's ``[kind]``."""
    out, at = [], 0
    for a, k, b in sorted((a, k, b) for k, a, b in found):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _texts(texts: pd.Series) -> list[str]:
    return ["" if t is None or t != t else t for t in texts]


@cache
def find_udf():
    """array<struct<kind, start, end>> of a text column."""
    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans(t)]
                             for t in _texts(texts)], dtype=object)
    return find


@cache
def scan_udf():
    """struct(n_email, n_ip, n_card, n_phone, base_sha256, spans) of a text column."""
    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in _texts(texts):
                found = spans(text)
                base = [s for s in found if s[0] < len(BASE)]
                rows.append((*(sum(s[0] == k for s in base) for k in range(len(BASE))),
                             hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
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


def find(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per span: ``keep`` columns, kind, start, end and the span's own text as value."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    found = rows.withColumn("__span", F.explode(find_udf()(F.col("__text"))))
    return found.select(*keep, "__span.*", F.substring(
        F.col("__text"), F.col("__span.start") + 1, F.col("__span.end") - F.col("__span.start")).alias("value"))


def redact(text: Column) -> Column:
    """A text column with personal data replaced by its kind; null stays null."""
    return F.when(text.isNotNull(), redact_udf()(text))
