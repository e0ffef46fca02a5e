import hashlib
import random
import re
import time

from heatwise.llm import pii

PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: card(re.sub("[ -]", "", m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
]


def card(digits):
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
    return 16 <= len(digits) <= 19 and total % 10 == 0


def brute(text):
    """(counts, listing) of the base kinds by whole searches."""
    found = [[f"{k}:{m.start()}:{m.end()}" for m in p.finditer(text or "") if ok(m)] for k, p, ok in PATTERNS]
    return [len(f) for f in found], ",".join(s for f in found for s in f)


def base(text):
    return pii.listed([s for s in pii.spans(text) if s[0] < 4])


def test_documents_match_whole_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts, spans = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert all(sum(r[c] for r in rows) > 0 for c in ("n_email", "n_ip", "n_card", "n_phone"))


def test_random_texts_match_whole_search():
    rng = random.Random(7)
    parts = ["@", ".", "+", "-", " ", "  ", "a", "b.c", "1", "12", "255", "256", "007", "x@y.z", "a@b", "(", ")",
             "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "+1 (555) 555-0199", "é", "\U0001f600", "\n", "_", "%", "0000"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert base(text) == brute(text)[1], repr(text)


def test_long_texts_take_linear_time():
    for unit, end in [("1", ""), ("1.", ""), ("a@", ""), ("+1", ""), ("a", "@b.c"), ("1 ", ""), ("(", ""), ("a@b.c@", ""),
                      ("://", ""), ("account ", ""), ("1.2.3.", ""), ("+1 (", "")]:
        assert base(unit * 300 + end) == brute(unit * 300 + end)[1]
        t = time.perf_counter()
        pii.spans(unit * 100_000 + end)
        assert time.perf_counter() - t < 5, unit


def kinds(text):
    return [pii.KINDS[k] for k, _, _ in pii.spans(text)]


def test_method_kinds():
    assert kinds("ask @some_name or me@x.org, not a@ or x@y") == ["email", "handle"]
    text = "ftp://joe:pw1@host/x https://host/@no"
    assert pii.listed(pii.spans(text)) == "userinfo:6:13"
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00.") == []
    assert kinds("Account no. 1234-5678 and account 12345") == ["account"]
    assert kinds("account 4111111111111111") == ["card"]       # a base span covers it
    assert kinds("account 12345678x") == []


def test_edge_rows_and_interface(spark):
    text = "\U0001f600 mail a.b@c.de or 10.0.0.1"
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (None, text, 7)],
                               "doc_id long, text string, spans int")
    rows = sorted(pii.scan(df).collect(), key=lambda r: r.doc_id or 0)
    assert rows[0].spans == "email:7:15,ip:19:27" and [r.spans for r in rows[1:]] == ["", "", ""]
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.scan(df.where("false")).count() == 0
    assert [(r.kind, r.value) for r in pii.find(df).collect()] == [("email", "a.b@c.de"), ("ip", "10.0.0.1")]
    out = df.withColumn("text", pii.redact(df["text"])).collect()
    assert [r.text for r in out] == [None, None, "", "\U0001f600 mail [email] or [ip]"]
