import random

import pytest
import sentencepiece
from public_tokenizers import path

from heatwise.llm import piece

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _ids(text):
    import numpy as np
    return np.frombuffer(piece.encoder(MODEL).encode(text), dtype="<i4")


def test_documents_match_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = piece.decode(piece.encode(docs, MODEL), MODEL).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode(r.text, add_eos=True)
        assert list(r.ids) == want and r.decoded == library.decode(want)


def test_random_texts_match_library(library):
    rng = random.Random(3)
    pools = ["ab ", "aeinrst  ", "the and of ing\n\t ", " ▁", "日本語 x", "é́\U0001f600‍ ", "<0x0A></s><s>", "0123 ..--==", "\x00\x7f\x80　\xa0\r"]
    for n in range(3000):
        pool = rng.choice(pools) + rng.choice(pools)
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        want = library.encode(text, add_eos=True)
        assert _ids(text).tolist() == want, repr(text)
        assert piece.encoder(MODEL).vocabulary.decode(_ids(text)) == library.decode(want), repr(text)


def test_long_runs_without_blanks(library):
    for text in ["ab" * 20000, "=" * 5000, " " * 3000, "internationalization" * 500, "日" * 3000]:
        assert _ids(text).tolist() == library.encode(text, add_eos=True)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "", 4), (2, " a", 5)], "doc_id long, text string, ids int")
    rows = piece.decode(piece.encode(df, MODEL), MODEL).collect()
    assert [list(r.ids) for r in rows[:3]] == [[2]] * 3 and rows[3].ids[-1] == 2
    assert [r.decoded for r in rows] == ["", "", "", " a"]
    assert piece.encode(df.where("false"), MODEL).count() == 0


def test_invalid_byte_sequences_decode_like_library(library):
    import numpy as np
    rng = random.Random(5)
    for _ in range(500):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(259, 400)]) for _ in range(rng.randint(1, 12))]
        assert piece.encoder(MODEL).vocabulary.decode(np.array(ids)) == library.decode(ids), ids
