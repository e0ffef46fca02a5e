import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from heatwise.llm import collocations as co


def brute(rows, min_count, top, max_words=5):
    """Plain dictionaries over all (lang, text) rows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    count[lang][tuple(w[i:i + m])] += 1
    out = []
    for lang, f in count.items():
        good = {p: a for p, a in f.items() if a >= min_count and len(p) > 1}
        kept = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in good.items()):
                continue
            cuts = [(1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in co.mine(df, **kw).collect())


SCHEMA = "doc_id long, text string, lang string, n int, id string"


def corpus(seed, docs):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", "é", "É", "日本", "x-1", "a", "b", "c", "d", "New", "york", "city", "very"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(docs):
        words = [rng.choice(vocabulary[:8] if rng.random() < 0.6 else vocabulary) + rng.choice(["", "", "", ".", ",", "\n", ";x"])
                 for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            words += ["new york city is very big"] * rng.randrange(1, 4)
        rows.append((i, rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "en", "en", "fr", None, "und"]), 1, "z"))
    return rows + [(None, None, "en", 1, "z"), (1, "", "de", 1, "z"), (2, "!!! ,,", "es", 1, "z"), (3, "a a a a a a a a a a a a", None, 1, "z")]


@pytest.mark.parametrize("budget", [2_000_000, 300, 40, 3])
def test_equals_brute_force_at_every_budget(spark, monkeypatch, budget):
    rows = corpus(5, 120)
    monkeypatch.setattr(co, "GROUP_SUFFIXES", budget)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute([(r[2], r[1]) for r in rows], 5, 40)
    assert mined(df, min_count=5, top=40) == want and len(want) > 80


def test_hot_phrase_is_split_to_full_depth(spark, monkeypatch):
    """One phrase holds most words: its prefixes are over the budget at every depth."""
    rows = [(i, "one and the same phrase again and again", "en", 1, "z") for i in range(200)] + corpus(9, 20)
    monkeypatch.setattr(co, "GROUP_SUFFIXES", 50)
    monkeypatch.setattr(co, "BLOCK_SUFFIXES", 300)
    monkeypatch.setattr(co, "SLICE_BYTES", 2000)
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df, min_count=10, top=30) == brute([(r[2], r[1]) for r in rows], 10, 30)


def test_edge_tables(spark):
    df = spark.createDataFrame(corpus(1, 5), SCHEMA)
    assert co.mine(df.where("false")).collect() == [] and co.mine(df, min_count=10_000).collect() == []
    assert co.mine(df.where("text is null")).collect() == []
    long = "long " * 30_000 + "tail tail"
    rows = [(1, long, None, 1, "z"), (1, long, "und", 1, "z")]
    got = mined(spark.createDataFrame(rows, SCHEMA), min_count=2)
    assert got == brute([(r[2], r[1]) for r in rows], 2, 2000)
    three = mined(spark.createDataFrame(rows, SCHEMA), min_count=2, max_words=3, top=2)
    assert three == brute([(r[2], r[1]) for r in rows], 2, 2, 3)


def test_records_round_trip():
    rng = np.random.default_rng(0)
    rows = rng.integers(1, 4, (500, 5))
    for r in rows:
        r[rng.integers(2, 6):] = 0
    want = Counter(map(tuple, rows.tolist()))
    merged, n, shared, _ = co._merge(rows.T.astype(np.int32), np.ones(500, np.int64))
    assert dict(zip(map(tuple, merged.T.tolist()), n.tolist())) == want
    size = (merged > 0).sum(axis=0)
    tails = merged.T[(np.arange(5) >= shared[:, None]) & (np.arange(5) < size[:, None])]
    back = co._decoded((shared | size << 4).astype(np.uint8).tobytes(), co._narrow(tails), 5)
    assert (back == merged).all()
    assert co._widened(co._narrow(np.array([1, 300, 70_000]))).tolist() == [1, 300, 70_000]
    for values in ([], [0], [254, 255, 256, 0, 510, 100_000, 1]):
        assert co._unpacked(co._packed(np.array(values, dtype=np.int64))).tolist() == values


def test_scores_past_64_bits(spark):
    """The products of the score are exact decimals: counts of a large corpus, joined as mine() does."""
    row = spark.sql("select (1000 * cast(900000000123 as decimal(15,0)) * cast(999999999999 as decimal(15,0))) div "
                    "(cast(900000000457 as decimal(15,0)) * cast(900000000999 as decimal(15,0))) as s").first()
    assert row.s == 1000 * 900000000123 * 999999999999 // (900000000457 * 900000000999)
