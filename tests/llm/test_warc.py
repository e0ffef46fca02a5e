import gzip
import random

from heatwise.llm import warc
from heatwise.llm.scratch import Scratch


def _expected(rows):
    first = {}
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, html in rows:
        data = (html or "").encode()
        revisit = first.get(html or "") is not None and i != first[html or ""]
        out.append((i, len(data), warc.base32_sha1(data), "revisit" if revisit else "response",
                    first[html or ""] if revisit else None))
    return sorted(out, key=repr)


def _digest(df):
    from heatwise.llm.queries import warc_rows
    return sorted((tuple(r) for r in warc_rows(df).collect()), key=repr)


def test_pages_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = _digest(warc.round_trip(pages, Scratch(spark, "t")))
    assert got == _expected([(r.page_id, r.html) for r in pages.collect()])


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "u\r\nX: y", ""), (3, "http://é/ü", "same"), (3, "x", "same"), (4, "x", "same"),
            (None, "x", "same"), (None, None, "alone"), (9, "x", "big" * 400_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, first string")
    assert _digest(warc.round_trip(df, Scratch(spark, "t"))) == _expected([(r[0], r[2]) for r in rows])
    assert warc.round_trip(df.where("false"), Scratch(spark, "t")).count() == 0


def test_salvage_recovers_later_records_and_logs_gaps():
    rng = random.Random(4)
    plain = [warc.record(i, f"http://h/{i}", bytes(rng.randrange(256) for _ in range(300)), None, False) for i in range(6)]
    for pack in (lambda r: gzip.compress(r, 6, mtime=0), lambda r: r):
        parts = [pack(r) for r in plain]
        data = bytearray(b"".join(parts))
        at = [sum(map(len, parts[:i])) for i in range(7)]
        data[at[1] + len(parts[1]) // 2] ^= 0x55                  # damaged inside
        data[at[3]:at[3] + 4] = b"oops"                           # no magic, no version line
        got = list(warc.salvage(bytes(data)))
        assert [g[4]["record_id"] for g in got if g[0] == "record"] == [f"urn:page:{i}" for i in (0, 2, 4, 5)]
        assert [(g[1], g[2]) for g in got if g[0] == "gap"] == [(at[1], at[2]), (at[3], at[4])]
        assert all(g[3] for g in got if g[0] == "gap")
        cut = bytes(data[:at[5] + 40])                            # cut off in the last record
        got = list(warc.salvage(cut))
        assert got[-1][:3] == ("gap", at[5], len(cut))
    assert list(warc.salvage(b"")) == []
    assert [g[:3] for g in warc.salvage(b"nothing here")] == [("gap", 0, 12)]


def test_members_of_many_records_keep_their_good_ones():
    rng = random.Random(8)
    plain = [warc.record(i, f"http://h/{i}", bytes(rng.randrange(256) for _ in range(3000)), None, False) for i in range(20)]
    other = gzip.compress(warc.record(99, "u", b"next", None, False), mtime=0)

    def ids(data):
        got = list(warc.salvage(data))
        return [int(g[4]["record_id"].split(":")[-1]) for g in got if g[0] == "record"], [g for g in got if g[0] == "gap"]

    inner = b"".join(plain[:7]) + plain[7].replace(b"Content-Length: ", b"Content-Length: 9") + b"".join(plain[8:])
    whole = gzip.compress(inner, mtime=0)
    found, gaps = ids(whole + other)                              # a bad record in a sound member
    assert found == [i for i in range(20) if i != 7] + [99]
    assert [g[1:3] for g in gaps] == [(0, len(whole))] and str(sum(map(len, plain[:7]))) in gaps[0][3]
    whole = gzip.compress(b"".join(plain), mtime=0)
    for cut in (len(whole) // 2, len(whole) - 8, len(whole) - 1):  # cut off, alone and before another member
        first, gaps = ids(whole[:cut])
        assert first == list(range(len(first))) and len(first) >= 9 and gaps[-1][2] == cut
        found, gaps = ids(whole[:cut] + other)
        assert found == first + [99] and len(gaps) == 1 and gaps[0][2] == cut and gaps[0][3]
    for level in (0, 6):                                          # a flipped bit late in one stream
        bad = bytearray(gzip.compress(b"".join(plain), level, mtime=0))
        at = bad.find(plain[15][1000:1100]) if level == 0 else len(bad) * 3 // 4
        bad[at] ^= 0x10
        found, gaps = ids(bytes(bad) + other)
        lost = 15 if level == 0 else 14
        assert found == [i for i in range(20) if i != lost] + [99] and "digest differs" in gaps[0][3]


def test_payload_with_version_lines_and_members():
    inner = warc.record(7, "u", b"x", None, False)
    payload = b"WARC/1.1\r\n" + inner + gzip.compress(inner)
    for data in (warc.record(1, "u", payload, None, False) + inner, gzip.compress(warc.record(1, "u", payload, None, False)) + gzip.compress(inner)):
        assert [g[4]["payload_bytes"] for g in warc.salvage(data)] == [len(payload), 1]


def test_damaged_archives_through_spark(spark, tmp_path):
    good = [gzip.compress(warc.record(i, "u", b"p" * i, None, False)) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(good[0] + b"junk" + good[1])
    (tmp_path / "b.warc.gz").write_bytes(good[2][:-9] + good[3])
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("path", "start").collect()
    assert [(r.kind, r.record_id) for r in rows] == [("record", "urn:page:0"), ("gap", None), ("record", "urn:page:1"),
                                                     ("gap", None), ("record", "urn:page:3")]
    assert rows[2].payload == b"p"


def test_reading_time_a_record_does_not_grow_with_the_archive():
    import gzip
    import os
    import time
    member = [gzip.compress(warc.record(i, "http://a/", os.urandom(600), None, False), compresslevel=1, mtime=0) for i in range(2000)]
    size = sum(map(len, member))

    def best(copies):
        data, times = b"".join(member * copies), []
        for _ in range(3):
            t = time.perf_counter()
            n = sum(1 for found in warc.salvage(data) if found[0] == "record")
            times.append((time.perf_counter() - t) / n)
            assert n == 2000 * copies
        return min(times)
    small, large = best(1), best(-(-32_000_000 // size))
    assert large < 1.5 * small


def test_files_that_the_manifest_does_not_name_are_not_read(spark, tmpdir_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"body {i}") for i in range(20)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmpdir_path}/w").cache()
    n = sum(r["records"] for r in manifest.collect())
    import glob
    import shutil
    some = glob.glob(f"{tmpdir_path}/w/*.warc.gz")[0]
    shutil.copy(some, some.replace("part-", "part-9"))
    assert warc.read_listed(manifest).where("kind = 'record'").count() == n == 20
    assert warc.read_archives(spark, f"file://{tmpdir_path}/w").count() > 20
