import collections
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from heatwise.llm import neardup, textnum
from heatwise.llm.neardup import near_duplicates, deduplicate


def _shingles(text):
    words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    if not words:
        return collections.Counter()
    if len(words) < 5:
        return collections.Counter([tuple(words)])
    return collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows, threshold=0.8):
    """{id: smallest id of its component} by all pairs of distinct word sequences."""
    distinct = {}
    for i, t in rows:
        s = tuple(w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", t or "") if w)
        if s:
            distinct[s] = min(i, distinct.get(s, i))
    n = len(distinct)
    vec = {i: _shingles(" ".join(s)) for s, i in distinct.items()}
    df = collections.Counter(x for v in vec.values() for x in v)
    w = {i: {x: c * (1 + math.log(n / max(df[x], neardup.PHI * n))) for x, c in v.items()} for i, v in vec.items()}
    parent = {i: i for i in vec}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for i, v in vec.items():
        for x in v:
            inverted[x].append(i)
    pairs = {p for ids in inverted.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = sum(min(w[a][x], w[b][x]) for x in w[a].keys() & w[b].keys())
        if both / (sum(w[a].values()) + sum(w[b].values()) - both) >= threshold - 1e-12:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    out = {}
    for i, t in rows:
        s = tuple(q for q in __import__("re").split("[ \t\n\x0b\x0c\r]+", t or "") if q)
        out[i] = root(distinct[s]) if s else i
    return out


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_hub_group_needs_blockwise_comparison(spark, monkeypatch):
    """Near copies around one base: many pairs below the threshold, one component each."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"r{i}-{j}" for j in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == brute(rows)


def test_weights_count_every_document_frequency(spark):
    """A passage that 3 % of the texts share tells little: its holders are not duplicates."""
    passage = " ".join(f"p{j}" for j in range(94))
    rows = [(i, f"{passage} " + " ".join(f"o{i}-{j}" for j in range(10))) for i in range(60)]
    rows += [(1000 + i, " ".join(f"r{i}-{j}" for j in range(12))) for i in range(1940)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.class_id == r.doc_id and r.kept for r in near_duplicates(df).collect())


def test_estimate_misses_far_less_than_the_bands():
    places = neardup.BANDS * neardup.ROWS
    least = math.ceil(neardup.ESTIMATE * 0.8 * places)
    missed = sum(math.comb(places, k) * 0.8 ** k * 0.2 ** (places - k) for k in range(least))
    assert missed < 0.01 * (1 - 0.8 ** neardup.ROWS) ** neardup.BANDS


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", "c"), (4, "one two", "d"), (5, "one  two\n", "e"),
            (6, "one two", None), (6, "one two", None), (None, "one two", "x"), (None, None, None),
            (7, "long " * 20000, "y"), (8, "ein  wort", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = [tuple(r) for r in near_duplicates(df).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert [by[i][1] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 4, 4, 7, 8]
    assert sum(r[0] is None and r[3] for r in got) == 2
    left = deduplicate(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 2, 3, 4, 7, 8]
    assert near_duplicates(df.where("false")).count() == 0


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(1, 1 << 63, 900).astype(np.uint64))
    wa, wb = rng.uniform(0.5, 8, 600), rng.uniform(0.5, 8, 600)
    a, b = dict(zip(keys[:600].tolist(), wa)), dict(zip(keys[300:].tolist(), wb))
    for k in keys[300:600].tolist():
        b[k] = a[k]
    both = sum(a[k] for k in a.keys() & b.keys())
    true = both / (sum(a.values()) + sum(b.values()) - both)
    agree = []
    for salt in range(60):
        sh = np.concatenate([list(a), list(b)]).astype(np.uint64)
        sh = textnum.mix(sh + np.uint64(salt * 7919))
        sig = neardup.signatures(sh, np.array([*a.values(), *b.values()]), np.array([0, 600, 1200]))
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - true) < 0.03


@pytest.mark.parametrize("text", ["a b c d e f", " a\tb\nc\x0bd\x0ce\rf g ", "", "é ü 日本 x y z", "q"])
def test_word_and_shingle_counts(text):
    (_, _, off, data), = textnum.slices(pa.array([text, "a b c d e f", None]))
    h, at = textnum.words(off, data)
    n = len([w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", text) if w])
    assert np.diff(at).tolist() == [n, 6, 0]
    sh, sat = textnum.shingles(h, at)
    assert np.diff(sat).tolist() == [max(n - 4, min(n, 1)), 2, 0]
    if text.split() == list("abcdef"):
        assert (sh[:2] == sh[2:4]).all()


def test_copies_of_a_hub_bucket_travel_once(spark):
    """Rows sent for a bucket of many near copies and a few outsiders grow with the bucket."""
    members = spark.range(5000).select(F.lit(0).alias("band"), F.lit(7).cast("long").alias("h"), "id",
                                       F.when(F.col("id") < 4990, 0).otherwise(F.col("id")).alias("comp"))
    sent = neardup._blocks(members).cache()
    assert sent.count() == 4990 + 10 * (-(-4990 // neardup.BLOCK) + 1)
    met = sent.groupBy("g").agg(F.collect_set("id").alias("ids"))
    pairs = {(min(a, b), max(a, b)) for r in met.collect() for a in r.ids if a >= 4990 for b in r.ids if a != b}
    assert len(pairs) == 10 * 4990 + 45
    assert neardup._blocks(members.where("comp = 0")).count() == 0
