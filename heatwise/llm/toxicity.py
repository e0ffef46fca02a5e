"""Toxicity: boosted trees over dense text features, isotonic calibration.

Features come from one pass over the whole text: densities of a lexicon learned from the
training rows (words, and word beginnings of four to six letters, whose share among toxic
texts is far above that among others), the same with digit and symbol spelling undone,
hits of either kind near a second-person pronoun, and rates of capitals, punctuation,
exclamation marks, obfuscation (runs of digits or symbols in a word that has letters) and
repeated letters.  Every word that holds a substitute is looked up decoded as well; ``!`` and
``|`` at its edges are read both as letters and as marks.

Trees are fitted on at most about ``SAMPLE`` labelled rows chosen by hash (all rows where
there are fewer); a quarter of these, kept from lexicon and trees, fits the isotonic map from raw
probability to score.  Rows with ``crc32(id) % 5 = 0`` are held out of all learning.  Inputs
are the text alone.  Scoring is row by row: no shuffle, nothing depends on other rows.

Defined cases: a null text counts as empty and is scored; an id labelled more than once is
toxic if any label says so; null labels are ignored; without both classes among the training
rows every score is the share of toxic ones (0 without rows); a null id is not held out;
repeated rows are scored alike; existing columns of the names added here are replaced.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from heatwise.llm import textnum
from heatwise.llm.scratch import Scratch

SAMPLE, LEXICON, TREES, DEPTH = 20_000, 400, 20, 4
ROWS_AT_ONCE = 500
PREFIXES = (4, 5, 6)
NEAR = 40                 # characters between a lexicon hit and a pronoun
#: Second-person words in the corpus languages.
PRONOUNS = ("you", "your", "yours", "yourself", "u", "du", "dich", "dir", "dein", "deine", "euch", "ihr",
            "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros")
FEATURES = ("log_words", "lexicon", "lexicon_hits", "plain_lexicon", "near_second", "second", "capitals",
            "punctuation", "exclaims", "obfuscated", "stretched")
_WORD = re.compile(r"[^\W_]+")
_SPELT = str.maketrans("013457@$!|*", "oieastasil" + " ")
# a word with a digit or symbol; possessive, so a long word is passed over once
_ODD_WORD = re.compile(r"(?<![\w@$!|*#%])[^\W0-9]*+[0-9@$!|*#%][\w@$!|*#%]*+")
_ODD_RUN, _LETTER = re.compile(r"[0-9@$!|*#%]+"), re.compile(r"[^\W\d_]")
_FIELD = "__features"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _terms(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if len(w) <= 40 and not w.isdigit()}
    return {"=" + w for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) > n}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def out():
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
             pa.array([clean[k] for k in keys], pa.int64())], ["term", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else clean).update(_terms(text or ""))
            if len(toxic) + len(clean) > 1_000_000:
                yield out()
                toxic.clear()
                clean.clear()
    yield out()
    toxic.clear()
    clean.clear()
    textnum.give_back()


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """At most LEXICON terms; ``=word`` is a whole word, others are word beginnings."""
    ratio = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    best = (rows.select("text", "toxic").mapInArrow(_count_terms, "term string, toxic long, clean long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where(F.col("toxic") >= max(3, math.ceil(n_toxic / 200)))
            .withColumn("ratio", ratio).where(F.col("ratio") >= math.log(6))
            .orderBy((F.col("toxic") * F.col("ratio")).desc(), "term").limit(LEXICON))
    return sorted(r.term for r in best.collect())


def _spellings(word: str) -> set[str]:
    """A word with its substitutes read as letters, all as long as the word."""
    full = word.translate(_SPELT)
    out = {full}
    if word[0] in "!|" or word[-1] in "!|":
        head, tail = len(word) - len(word.lstrip("!|")), len(word.rstrip("!|"))
        if head < tail:
            rest = " " * (len(word) - tail)
            out |= {" " * head + full[head:], full[:tail] + rest, " " * head + full[head:tail] + rest}
    return out - {word}


class Measure:
    """Feature rows of texts under a lexicon."""

    def __init__(self, lexicon: list[str]):
        import ahocorasick
        self.found = ahocorasick.Automaton()
        kinds: dict[str, set[str]] = {}
        for term in lexicon:
            kinds.setdefault(term.lstrip("="), set()).add("whole" if term[0] == "=" else "start")
        for word in PRONOUNS:
            kinds.setdefault(word, set()).add("second")
        for term, kind in kinds.items():
            self.found.add_word(term, (len(term), "start" in kind, "whole" in kind, "second" in kind))
        self.found.make_automaton()

    def hits(self, text: str) -> tuple[list[int], list[int]]:
        """Word starts with a lexicon hit (ascending), and those of pronouns."""
        lexicon, second = [], []
        n, last = len(text), -1
        for end, (size, start_ok, whole_ok, is_second) in self.found.iter(text):
            at = end + 1 - size
            if at and text[at - 1].isalnum():
                continue
            whole = end + 1 == n or not text[end + 1].isalnum()
            if (start_ok or whole_ok and whole) and at != last:
                lexicon.append(at)
                last = at
            if is_second and whole:
                second.append(at)
        return lexicon, second

    def spelt(self, low: str) -> tuple[set[int], set[int], int]:
        """Starts of decoded lexicon hits and pronouns, and runs of odd characters in words."""
        lexicon, second, runs = set(), set(), 0
        for hit in _ODD_WORD.finditer(low):
            word, at = hit.group(), hit.start()
            if len(word) < 2:
                continue
            lettered = _LETTER.search(word)
            if lettered:
                runs += len(_ODD_RUN.findall(word.rstrip("!|*")))
            for spelling in _spellings(word):
                found, pronouns = self.hits(spelling)
                lexicon.update(at + i for i in found)
                if lettered:
                    second.update(at + i for i in pronouns)
        return lexicon, second, runs

    def rows(self, column: pa.Array) -> np.ndarray:
        out, size = np.zeros((len(column), len(FEATURES))), np.ones(len(column))
        for start, end, offsets, data in textnum.slices(column):
            out[start:end, 6:] = _byte_rates(offsets, data)
            size[start:end] = np.maximum(np.diff(offsets), 1)
            out[start:end, 0] = np.diff(np.concatenate([[0], np.cumsum(_word_starts(offsets, data))])[offsets])
        for i, text in enumerate(column.to_pylist()):
            if not text:
                continue
            words = max(out[i, 0], 1.0)
            low = text.lower()
            lexicon, second = self.hits(low)
            more, pronouns, runs = self.spelt(low)
            plain, around = sorted(more.union(lexicon)), sorted(pronouns.union(second))
            near, at = 0, 0
            for hit in plain:
                while at < len(around) and around[at] < hit - NEAR:
                    at += 1
                near += at < len(around) and around[at] <= hit + NEAR
            out[i, 1:6] = (100 * len(lexicon) / words, math.log1p(len(lexicon)), 100 * len(plain) / words,
                           100 * near / words, 100 * len(second) / words)
            out[i, 9] = 100 * runs / size[i]
        out[:, 0] = np.log1p(out[:, 0])
        return out


def _lut(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


_UPPER, _LOWER = _lut(bytes(range(65, 91))), _lut(bytes(range(97, 123)))
_MARKS, _EXCLAIM = _lut(b".,;:!?'\"()-"), _lut(b"!")
_BLANK = _lut(b" \t\n\x0b\x0c\r")


def _word_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    inside = ~_BLANK[data]
    first = inside.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first[1:] &= ~inside[:-1] | edge[1:-1]
    return first


def _byte_rates(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Capitals per letter; marks, exclamations, none for odd spellings, and stretched letters per byte."""
    def counts(flags):
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    upper = _UPPER[data]
    letter = upper | _LOWER[data]
    stretched = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        stretched[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    size = np.maximum(np.diff(offsets), 1)
    out = [counts(upper) / np.maximum(counts(letter), 1)]
    out += [100 * counts(flags) / size for flags in (_MARKS[data], _EXCLAIM[data])]
    out += [np.zeros(len(size)), 100 * counts(stretched) / size]
    return np.stack(out, axis=1)


def with_features(docs: DataFrame, lexicon: list[str], text_col: str = "text") -> DataFrame:
    """Add the feature array; all columns of docs stay."""
    made: list[Measure] = []

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not made:
            made.append(Measure(lexicon))
        for texts in batches:
            # a few texts at a time: their strings, Arrow columns and byte arrays exist for these only
            rows = [made[0].rows(pa.array(texts[low:low + ROWS_AT_ONCE], pa.string(), from_pandas=True))
                    for low in range(0, len(texts), ROWS_AT_ONCE)]
            del texts
            textnum.give_back()
            yield pd.Series([row for part in rows for row in part])
    return docs.withColumn(_FIELD, measure(F.col(text_col).cast("string")))


class Model:
    """A fitted scorer; ``share`` stands in where nothing could be learned."""

    def __init__(self, share: float, lexicon=None, trees=None, isotonic=None):
        self.share, self.lexicon, self.trees, self.isotonic = share, lexicon or [], trees, isotonic

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """All columns of docs and the score, 0 to 1."""
        if self.trees is None:
            return docs.withColumn(score_col, F.lit(self.share))
        out = with_features(docs, self.lexicon, text_col).withColumn("__vector", array_to_vector(_FIELD))
        out = self.trees.transform(out).withColumn("__raw", vector_to_array("__probability")[1])
        if self.isotonic is None:
            out = out.withColumn("__calibrated", F.col("__raw"))
        else:
            out = self.isotonic.transform(out)
        made = [_FIELD, "__vector", "__margin", "__probability", "__class", "__raw", "__calibrated"]
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("__calibrated", F.lit(self.share))))
        return out.withColumn(score_col, score).drop(*made)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = (labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
             .where("id is not null and toxic in (0, 1)").where(~held_out(F.col("id")))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    step = max(-(-known.count() // sample), 1)
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(known, "id")
    rows = rows.withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(4)) == 0)
    rows = scratch.keep(rows, "rows", "snappy")
    n = {(r.calibrates, r.toxic): r["count"] for r in rows.groupBy("calibrates", "toxic").count().collect()}
    total, toxic = sum(n.values()), n.get((True, 1), 0) + n.get((False, 1), 0)
    share = toxic / total if total else 0.0
    if not n.get((False, 1)) or not n.get((False, 0)):
        return Model(share)
    lexicon = learn_lexicon(rows.where("not calibrates"), n[False, 1], n[False, 0])
    featured = with_features(rows, lexicon).select("id", "toxic", "calibrates", _FIELD)
    featured = scratch.keep(featured, "features").withColumn("__vector", array_to_vector(_FIELD))
    trees = GBTClassifier(
        featuresCol="__vector", labelCol="toxic", predictionCol="__class", maxIter=TREES, maxDepth=DEPTH,
        stepSize=0.2, minInstancesPerNode=2, seed=7)
    trees = trees.setProbabilityCol("__probability").setRawPredictionCol("__margin").fit(
        featured.where("not calibrates").orderBy("id"))
    isotonic = None
    if n.get((True, 1)) and n.get((True, 0)):
        raw = trees.transform(featured.where("calibrates")).select(
            F.col("toxic").cast("double").alias("toxic"), vector_to_array("__probability")[1].alias("__raw"))
        isotonic = IsotonicRegression(featuresCol="__raw", labelCol="toxic", predictionCol="__calibrated").fit(raw)
    return Model(share, lexicon, trees, isotonic)
