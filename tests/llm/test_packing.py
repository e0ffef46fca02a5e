import collections
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from heatwise.llm import packing

WORDS = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def check(rows, ids_of, capacity, segments, loss):
    """Every id in exactly one piece, sequences gapless and within limits; returns padding share."""
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            part = np.array(ids_of[doc][p.start:p.start + p.length], dtype="<u4").tobytes()
            assert p.start == at and p.length > 0 and p.ids_crc32 == zlib.crc32(part)
            assert p.doc_tokens == len(ids_of[doc])
            at += p.length
        assert at == len(ids_of[doc])
    used = paid = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and len(pieces) <= segments and sum(p.loss_tokens for p in pieces) <= loss
        used += at
        paid += at if at & (at - 1) == 0 else capacity
    return 1 - used / paid


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids_of = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack(docs, WORDS).collect()
    assert check(rows, ids_of, 4096, packing.SEGMENTS, 4096) < 0.001


def test_tokens_match_library_behind_every_letter():
    """Each letter before each mark, alone and inside words, against the unmodified library."""
    plain = Tokenizer.from_file(WORDS)
    ours = packing.Tokens(WORDS, added=True)
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    for mark in ".,;:!?":
        texts = [c + mark + ("x" if i % 2 else "") for i, c in enumerate(letters)]
        for low in range(0, len(texts), 20_000):
            want = [np.array(e.ids + [2], dtype="<u4").tobytes() for e in plain.encode_batch_fast(texts[low:low + 20_000], add_special_tokens=False)]
            assert ours.encode(texts[low:low + 20_000], 2) == want, mark
    for text in ["\u0130.\u00d6. 45", "\u0130!", "a\u0958.b", "\ufb1d?", "\u09dc;\u09dd:"]:
        assert ours.encode([text], 2) == [np.array(plain.encode(text, add_special_tokens=False).ids + [2], dtype="<u4").tobytes()]


def test_tokens_match_library_on_odd_texts(library):
    rng = random.Random(2)
    pools = ["ab'st ll 're", "ÀÉ̈ ΣΑΣ ", "日本1２3 ", "\x1c\x85\xa0\t\r\n x", "<|endoftext|> ", "_-=+ \U0001f600", " ́a"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|> a", "x" * 5000, "= " * 4000]
    got = packing.tokens(WORDS).encode(texts, 2)
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, dtype="<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_added_tokens_match_unmodified_library(spark):
    plain = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    pools = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "ab'st ll ", "À.É̈ ΣΑΣ ", "Foo. Bar", "\n\t"]
    texts = ["".join(rng.choice(pools) for _ in range(rng.randint(0, 12))) for _ in range(1000)]
    texts += ["a<|endoftext|>b", "<|ENDOFTEXT|> b", "foo.<|endoftext|>.Bar", "<|endoftext|>", "<|startoftext|> x"]
    ids_of = {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert ids_of[1000] == [320, 49407, 321, 2]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS).collect()
    check(rows, ids_of, 4096, packing.SEGMENTS, 4096)


@pytest.mark.parametrize("segments,loss", [(128, 64), (3, 64), (8, 20)])
def test_limits_hold_together(spark, library, segments, loss):
    rng = random.Random(7)
    rows = [(i, "a " * rng.choice([0, 1, 3, 20, 70, 300]), rng.choice([None, -1, 0, 5, 50, 400])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt int").repartition(3)
    ids_of = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t, _ in rows}
    out = packing.pack(df, WORDS, capacity=64, segments=segments, loss=loss, prompt_col="prompt", with_ids=True).collect()
    check(out, ids_of, 64, segments, loss)
    prompt = {i: max(p or 0, 0) for i, _, p in rows}
    assert all(r.loss_tokens == sum(k >= prompt[r.doc_id] for k in range(r.start, r.start + r.length)) for r in out)
    assert all(list(r.ids) == ids_of[r.doc_id][r.start:r.start + r.length] for r in out)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "", 1), (2, "x " * 9000, 2)], "doc_id long, text string, start int")
    rows = packing.pack(df, WORDS).collect()
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {(1, 1), (None, 1), (2, 9001)}
    twice = packing.pack(df.union(df), WORDS).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in rows)
    assert packing.pack(df.where("false"), WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, WORDS, capacity=100)
