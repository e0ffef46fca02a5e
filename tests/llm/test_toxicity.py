import zlib

import pytest

from heatwise.llm import toxicity


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    return model, model.score(docs.select("doc_id", "text")).join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    _, rows = scored
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    fold = rows[rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0) & rows.toxic.notna()]
    bad, good = fold[fold.toxic == 1].score.values, fold[fold.toxic == 0].score.values
    auc = ((bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean())
    assert auc > 0.95
    assert ((fold.score >= 0.5) == (fold.toxic == 1)).mean() > 0.97
    assert (good >= 0.5).mean() < 0.01


def test_fold_is_crc32(spark):
    ids = spark.range(50).select("id", toxicity.held_out(__import__("pyspark").sql.functions.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids.collect())


def test_features_of_odd_texts():
    import numpy as np
    import pyarrow as pa
    m = toxicity.Measure(["=idiot", "lowei"])
    rows = m.rows(pa.array(["You are an IDIOT!", "1d10t idi0t", None, "", "loweischaft Idioten slowei", "x" * 300_000]))
    f = dict(zip(toxicity.FEATURES, rows.T))
    assert f["lexicon"].tolist() == [25.0, 0.0, 0.0, 0.0, pytest.approx(100 / 3), 0.0]
    assert f["plain_lexicon"][1] == 100.0 and f["near_second"][0] == 25.0 and f["near_second"][4] == 0
    assert f["stretched"][5] > 99 and np.isfinite(rows).all()


@pytest.mark.parametrize("text", ["1d10t", "id10t", "idi0t", "1D10T!", "!!1d10t", "!d!ot!", "$tupid", "$tup!d", "@ss", "a$$", "a$$!",
                                  "4rschloch", "\u00e41d10t 1d10t", "trottel \u00fcb3l"])
def test_each_spelling_alone(text):
    import pyarrow as pa
    m = toxicity.Measure(["=idiot", "=stupid", "=ass", "arsch", "=\u00fcbel"])
    row = dict(zip(toxicity.FEATURES, m.rows(pa.array(["y0u " + text]))[0]))
    assert row["lexicon"] == 0 and row["obfuscated"] > 0
    assert row["plain_lexicon"] == row["near_second"] == pytest.approx(100 / (1 + len(text.split())))


def test_plain_numbers_and_marks_are_not_obfuscated():
    import pyarrow as pa
    m = toxicity.Measure(["=idiot"])
    rows = dict(zip(toxicity.FEATURES, m.rows(pa.array(["in 1950 for $100!", "so, idiot! well!", "73 idiot"])).T))
    assert rows["obfuscated"].tolist() == [0, 0, 0] and rows["plain_lexicon"].tolist() == rows["lexicon"].tolist()
    assert rows["near_second"].tolist() == [0, 0, 0]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.3), (2, "", 0.1), (None, "idiot", 0.2), (2, "", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    rows = toxicity.fit(docs, none).score(docs).collect()
    assert [r.score for r in rows] == [0.0] * 4 and rows[0].__fields__ == ["doc_id", "text", "score"]
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.fit(docs.where("doc_id is not null"), one).score(docs).collect()} <= {0.0, 1.0}
    assert toxicity.fit(docs.where("false"), none).score(docs.where("false")).count() == 0
    texts = spark.createDataFrame([(i, ("idiot " if i % 3 == 0 else "fine ") * 6) for i in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(texts, marks)
    got = {r.doc_id: r.score for r in model.score(docs.union(texts.selectExpr("doc_id", "text", "0.0D as score"))).collect() if r.doc_id is not None and r.doc_id > 2}
    assert all((s >= 0.5) == (i % 3 == 0) for i, s in got.items())
