import hashlib
import re

from heatwise.llm import secrets

PATTERNS = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
     lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(PATTERNS)
             for m in p.finditer(text or "") if ok(m)]
    counts = [sum(f[1] == k for f in found) for k in range(3)]
    return counts, ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(found))


def test_documents_match_whole_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = secrets.scan(docs).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        counts, base = brute(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_tricky_texts():
    for text in ["password=secret=token=abcdef", "API_KEY : 'abc' apikey=\"abcdefg", "tokentoken=123456 AKIAAKIA" + "A" * 16,
                 "paſſword=abcdef toKen=abcdef", "\U0001f600 secret = x.y.z-1 " + "0123456789abcdef" * 3,
                 "passwdpassword:abc" + "AKIA" + "B" * 15, "a" * 23 + "g" + "a" * 24, "token=token=token=abc", "",
                 "secret" + " " * 5000 + "token=abcdef", "token==" + "=" * 7 + " secret:"]:
        found = [s for s in secrets.spans(text) if s[1] < 3]
        assert secrets.listed(found) == brute(text)[1], text


def test_checksums_and_redaction(spark):
    body = "a1B2" * 7 + "zz"
    good = "ghp_" + body + secrets.checksum(body)
    bad = "ghp_" + body + "000000"
    assert [secrets.KINDS[s[1]] for s in secrets.spans(f"x {good} y {bad} npm_{good[4:]}")] == ["github", "npm"]
    text = f"a {good} b"
    assert secrets.redacted(text, secrets.spans(text)) == "a [secret] b"
    text = "k password=0123456789abcdef0123456789abcdef!"
    assert secrets.redacted(text, secrets.spans(text)) == "k [secret]!"
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (None, text, 7)], "doc_id long, text string, spans int")
    rows = sorted(secrets.scan(df).collect(), key=lambda r: r.doc_id or 0)
    assert [r.n_assign for r in rows] == [1, 0, 0, 0] and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(df.where("false")).count() == 0
    out = df.withColumn("text", secrets.redact(df["text"])).collect()
    assert [r.text for r in out] == [None, None, "", "k [secret]!"]
