import itertools
import re

import pytest

from heatwise.llm import chat, quality, urlfilter
from heatwise.llm.queries import QUERIES, url_rules

PYTHON = re.compile("Python|Pandas|Arrow|Scan ExistingRDD")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- op1

def _judged(urls, rules):
    out = []
    for url in urls:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in host)
        fit = [(len(h), len(p or ""), v, h + (p or "")) for h, p, v in rules
               if h and v and (host == h or host.endswith("." + h)) and path.startswith(p or "") and host]
        best = max(fit, default=None)
        out.append((host, path, best and best[3], best[2] if best else "allow"))
    return out


URLS = [None, "", "no scheme", "http://", "http://a.NET", "http://A.net/", "https://x.Example.net/en/1?q=/fr/", "ftp://example.net/enx",
        "http://notexample.com/de/", "http://example.com/de/#x", "http://example.com/de", "http://org/fr/a/b/c", "http://a.org/fr/../x",
        "http://example.com:80/de/", "http://u@example.com/de/", "http://É.Net/x", "x://y://net/z", "http://a..net/", "http://net./",
        "http://example.com//de/", "http://" + "a." * 3000 + "net/" + "b/" * 3000, "http://İ.net/\nq", "http://example.net?x=/en/"]


def test_urls_match_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(3, "http://", "clash")], "page_id long, url string, host string")
    for rules in (url_rules(spark), url_rules(spark).where("false"),
                  spark.sql("SELECT * FROM VALUES ('a.net', '', 'allow'), ('net', '/', 'block'), ('net', '/b/b/', 'allow'), "
                            "('example.com', '/de/', 'allow'), ('example.com', '/de/', 'block'), ('org', null, 'block') AS t(host, path, verdict)")):
        listed = [tuple(r) for r in rules.select("host", "path", "verdict").collect()]
        got = sorted((tuple(r) for r in urlfilter.judge(df, rules, keep=("page_id",)).collect()), key=repr)
        want = [(i, *j) for i, j in enumerate(_judged(URLS, listed))] + [(3, *_judged(["http://"], listed)[0])]
        assert got == sorted(want, key=repr)
    assert urlfilter.judge(df.where("false"), url_rules(spark)).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(df, spark.sql("SELECT 'a' host, '/x' path, 'block' verdict"))


# --- op2

def _maximal(rows):
    convs = {}
    for c, t, role, text in set(rows):
        convs.setdefault(c, []).append(((t is not None, t or 0), __import__("hashlib").md5(f"{role or ''}\x1f{text or ''}".encode()).hexdigest(), t, role or "", text or ""))
    seqs = {c: sorted(v) for c, v in convs.items()}
    key = {c: tuple(x[1] for x in v) for c, v in seqs.items()}
    stay = {}
    for c, k in key.items():
        if any(len(o) > len(k) and o[:len(k)] == k for o in key.values()):
            continue
        if k not in stay or (stay[k] is None, stay[k] or 0) > (c is None, c or 0):
            stay[k] = c
    return sorted(((c, x[2], i + 1, len(k), x[3], f"<|im_start|>{x[3]}\n{x[4]}<|im_end|>\n")
                   for k, c in stay.items() for i, x in enumerate(seqs[c])), key=repr)


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    rows = [(1, i, *t) for i, t in enumerate(turns[:2])] + [(2, 10 * i, *t) for i, t in enumerate(turns)]
    rows += [(3, i, *t) for i, t in enumerate(turns[:3])] + [(4, i, *t) for i, t in enumerate(turns)]
    rows += [(5, 0, "user", "hi"), (6, 0, "user", "other"), (7, 1, "user", "other"), (None, 0, None, None), (None, None, "user", "x")]
    rows += [(8, 0, "user", "b"), (8, 0, "user", "a"), (8, 0, "user", "a"), (9, i, "user", f"t{i}") if False else (9, 0, "user", "long " * 30000)]
    rows += [(100, i, "user", f"turn {i % 7}") for i in range(500)] + [(101, i, "user", f"turn {i % 7}") for i in range(300)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, key string")
    got = sorted((tuple(r) for r in chat.render(df).collect()), key=repr)
    assert got == _maximal(rows)
    assert {r[0] for r in got} == {2, 6, 8, 9, 100, None}
    assert chat.render(df.where("false")).count() == 0


# --- op5

def _base(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search("[^ \t\n\x0b\x0c\r]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    odd = [None, "", " \n\t", "a b c d e a b c d e f", "x\n x\nx\n\n\nx", "a " * 5, "a " * 20000, "é日\U0001f600 #*$%&|<> \x0b\x0c\x85 \xa0",
           "a\x1cb c\x1fd", "\n".join(["same line here"] * 9), "p q r s t p q r s t u v w x q r s t p"]
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)] * 2, "doc_id long, text string")
    texts |= {-1 - i: t for i, t in enumerate(odd)}
    rows = quality.with_measures(docs.union(extra)).collect()
    assert len(rows) == docs.count() + 2 * len(odd)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == _base(texts[r.doc_id]), texts[r.doc_id]


def test_posterior_keeps_clean_and_rejects_junk(spark):
    out = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.1")
    assert [t for c, t in out.dtypes if c in COLUMNS + ["kept"]] == ["bigint"] * 5 + ["boolean"] * 2
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = out.drop("quality").join(labels, "doc_id").collect()
    judged = [r for r in rows if not r.base_failed]
    assert not any(r.kept for r in rows if r.base_failed)
    good, bad = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_em_recovers_accuracies(spark):
    """Votes drawn from known accuracies; the estimates come back."""
    import random
    rng = random.Random(1)
    names = list(quality.RULES)
    right_good = {n: 0.9 + 0.01 * i for i, n in enumerate(names)}
    counts = {}
    for _ in range(20000):
        good = rng.random() < 0.8
        vote = tuple(-1 if rng.random() < 0.1 else int(rng.random() < (right_good[n] if good else 0.4)) for n in names)
        counts[vote] = counts.get(vote, 0) + 1

    class Counted:
        def collect(self):
            return [dict(zip(names, v), count=c) for v, c in counts.items()]
        count = select = groupBy = lambda self, *a: self
    model = quality.fit(Counted())
    assert abs(model["good"] - 0.8) < 0.04
    assert all(abs(model["right_good"][n] - right_good[n]) < 0.03 for n in names)


def test_verdicts_match_a_plain_posterior(spark):
    """Votes, EM over the single rows (not their patterns) and posteriors in plain numpy."""
    import numpy as np
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    measured = quality.with_measures(docs).drop("text").cache()
    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    rows = [r.asDict() for r in measured.collect()]

    def holds(rule, row):
        text = rule.replace(" = 0", " == 0")
        for word in ("between",):
            while word in text:
                left, right = text.split(word, 1)
                low, high = right.split("and", 1)
                text = f"{low.strip()} <= ({left.strip()}) <= {high.strip()}"
        return bool(eval(text, {}, row))

    votes = np.array([[0 if holds(bad, r) else 1 if holds(good, r) else -1 for good, bad in quality.RULES.values()] for r in rows])
    cast, yes, n = votes >= 0, votes == 1, len(rows)
    share, rg, rb = quality.START["good"], np.full(votes.shape[1], quality.START["right_good"]), np.full(votes.shape[1], quality.START["right_bad"])

    def posterior():
        g, b = np.clip(rg, 1e-6, 1 - 1e-6), np.clip(rb, 1e-6, 1 - 1e-6)
        odds = np.where(yes, np.maximum(np.log(g / (1 - b)), 0), np.where(cast, np.minimum(np.log((1 - g) / b), 0), 0.0))
        return 1 / (1 + np.exp(-(odds.sum(axis=1) + np.log(share / (1 - share)))))
    held = quality.PRIOR_SHARE * n
    for _ in range(quality.ITERATIONS):
        p = posterior()[:, None]
        share = (p.sum() + held * quality.START["good"]) / (n + held)
        rg = ((p * yes).sum(axis=0) + held * quality.START["right_good"]) / ((p * cast).sum(axis=0) + held)
        rb = (((1 - p) * (cast & ~yes)).sum(axis=0) + held * quality.START["right_bad"]) / (((1 - p) * cast).sum(axis=0) + held)
    for r, p in zip(rows, posterior()):
        assert abs(got[r["doc_id"]].quality - p) < 1e-6
        if abs(p - 0.5) > 1e-6:
            assert got[r["doc_id"]].kept == (not r["base_failed"] and p >= 0.5)


def test_quality_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_words string")
    measured = quality.with_measures(empty)
    assert quality.with_verdict(measured, quality.fit(measured)).count() == 0
    one = quality.with_measures(spark.createDataFrame([(None, None, "x")], empty.schema))
    row = quality.with_verdict(one, quality.fit(one)).collect()[0]
    assert row.n_words == 0 and row.base_failed and not row.kept


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_chat_format", "op5_quality_rules"])
def test_native_plans_hold_no_python(spark, name):
    assert not PYTHON.search(_plan(QUERIES[name](spark, "/root/testdata/sf0.001")))
