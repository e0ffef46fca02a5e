import os

from pyspark.sql import functions as F

from heatwise.sources.files import (discover_files, discovery_counts, ingest_report,
                                    read_labelled_csv, read_readings, read_scoring_batch)


def write(d, name, text):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)
    return p


HEADER = "nodenumber,    x-coordinate,    y-coordinate,     temperature\n"


def test_comma_with_header_and_padding(spark, tmpdir_path):
    write(tmpdir_path, "20mm/a.csv", HEADER
          + "             1, 0.000000000E+00, 0.000000000E+00, 2.996816367E+02\n"
          + "             2, 1.000000000E+00, 0.500000000E+00, 3.100000000E+02\n")
    df = read_readings(spark, tmpdir_path)
    rows = sorted(df.collect(), key=lambda r: r["node_number"])
    assert [r["node_number"] for r in rows] == ["1", "2"]
    assert rows[0]["temperature"] == 299.6816367 and rows[1]["y"] == 0.5


def test_separators_and_rejections(spark, tmpdir_path):
    write(tmpdir_path, "ws.dat", "2 -1.623183 1.074091 311.318623\n  3 0 0 300\n")
    write(tmpdir_path, "tab.txt", "1\t0\t0\t300\n2\t1\t1\t301\n")
    write(tmpdir_path, "semi.csv", "1;0;0;300\n2;1;1;301\n")
    write(tmpdir_path, "three.csv", "1,0,0\n2,1,1\n")
    write(tmpdir_path, "five.csv", "1,0,0,300,9\n2,1,1,301,9\n")
    write(tmpdir_path, "empty.csv", "")
    write(tmpdir_path, "blank.csv", "\n\n   \n")
    write(tmpdir_path, "longer.csv", "1,0,0,300\n2,1,1,301,5\n")       # longer row: ',' fails
    write(tmpdir_path, "ignored.json", "1,0,0,300\n")
    rep = {os.path.basename(r["file_path"]): r for r in ingest_report(spark, tmpdir_path).collect()}
    assert rep["ws.dat"]["separator"] == r"\s+" and rep["ws.dat"]["accepted"]
    assert rep["tab.txt"]["separator"] == "\t"
    assert rep["semi.csv"]["separator"] == ";"
    assert not rep["three.csv"]["accepted"]
    assert not rep["five.csv"]["accepted"] and rep["five.csv"]["n_fields"] == 5
    assert not rep["longer.csv"]["accepted"]
    assert "ignored.json" not in rep and "empty.csv" not in rep and "blank.csv" not in rep
    df = read_readings(spark, tmpdir_path)
    counts = {r["file_name"]: r["count"] for r in df.groupBy("file_name").count().collect()}
    assert counts == {"ws.dat": 2, "tab.txt": 2, "semi.csv": 2}


def test_coercion_and_null_rules(spark, tmpdir_path):
    write(tmpdir_path, "c.csv", "\n".join([
        "1,0,0,300", "2,abc,0,300", "3,,0,300", "4,nan,0,300", "5,inf,0,300",
        "6,0,0,250", "7,0,0,1000", "8,0,0", "9,0,0,285", "NA,0,0,300"]) + "\n")
    df = read_readings(spark, tmpdir_path)
    got = sorted(r["node_number"] for r in df.collect())
    # abc -> null, '' and nan are NA, inf is a number (kept), 250/1000 excluded, short row
    # dropped, NA node dropped
    assert got == ["1", "5", "9"]


def test_discovery_rules(spark, tmpdir_path):
    write(tmpdir_path, "20mm/20mm, 1000mm-0005", "x")
    write(tmpdir_path, "20mm/test-0035", "x")
    write(tmpdir_path, "20mm/.hidden1", "x")
    write(tmpdir_path, "20mm/readme", "x")
    write(tmpdir_path, "25mm/abc1.csv", "x")
    write(tmpdir_path, "25mm/contours/a.PNG", "x")
    write(tmpdir_path, "25mm/contours/ffmpeg_command.txt", "x")
    d = discover_files(spark, tmpdir_path)
    c = {r["hole_size"]: (r["file_count"], r["image_count"])
         for r in discovery_counts(d).collect()}
    assert c == {"20mm": (2, 0), "25mm": (1, 1)}


def test_labelled_csv_fills_missing(spark, tmpdir_path):
    write(tmpdir_path, "l.csv", "nodenumber,x-coordinate,y-coordinate,temperature,leak_status\n"
          "1,0.1,0.2,310.5,1\n2,0.0,0.0,300.0,0\n")
    df = read_labelled_csv(spark, os.path.join(tmpdir_path, "l.csv"))
    r = {x["node_number"]: x for x in df.collect()}
    assert r["1"]["hole_size"] == "30mm" and r["1"]["file_name"] == "direct_upload"
    assert abs(r["1"]["leak_confidence"] - 0.9) < 1e-12 and r["0" if False else "2"]["criteria_count"] == 1


def test_scoring_batch_defaults(spark, tmpdir_path):
    write(tmpdir_path, "s.csv", "x,y,temperature,hole_size\n1,1,310,25mm\n,,,\n")
    df = read_scoring_batch(spark, os.path.join(tmpdir_path, "s.csv"))
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(0.0, 0.0, 300.0, "30mm"), (1.0, 1.0, 310.0, "25mm")]


def test_field_count_equals_split_size(spark):
    from heatwise.sources.files import SEPARATORS, _tokens, field_count
    lines = ["a,b,,d", "  1 2\t3  4 ", "x;y;z;w;", "single", ",", "a\tb\t\tc", "  lead , x",
             "\t 7 0 0 300\t"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    for sep in SEPARATORS:
        got = df.select(field_count(F.col("value"), sep).alias("a"),
                        F.size(_tokens(F.col("value"), sep)).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got), sep


def test_leading_tab_whitespace_file(spark, tmpdir_path):
    write(tmpdir_path, "t.dat", "\t1 0 0 300\n \t2 1 1 301 \n")
    rows = sorted(r["node_number"] for r in read_readings(spark, tmpdir_path).collect())
    assert rows == ["1", "2"]


def test_hole_size_from_name_substring_rule(spark):
    from heatwise.functions.exprs import hole_size_from_name, hole_size_from_path
    names = ["25mm, 1200mm-0005", "test-0035", "test-0030", "40MM_leak.dat", "abc"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(hole_size_from_name(F.col("n"), "30mm")).collect()]
    # "25mm, 1200mm" contains "20" and is found as 20mm first; "test-0030" contains "30"
    assert got == ["20mm", "30mm", "30mm", "40mm", "30mm"]
    got2 = [r[0] for r in df.select(hole_size_from_name(F.col("n"), "20mm")).collect()]
    assert got2[1] == "20mm" and got2[4] == "20mm"
    p = spark.createDataFrame([("file:/d/25mm/x.csv",), ("file:/d/other/x.csv",)], "p string")
    assert [r[0] for r in p.select(hole_size_from_path(F.col("p"))).collect()] == ["25mm", None]


def test_a_line_is_split_once_and_files_are_not_sorted(spark, tmpdir_path):
    """(Before: the split stood in every condition and column, about twenty times a line; lines
    were sorted to find each file's first one.)"""
    from heatwise.sources.files import SEPARATORS, read_lines, separator_decisions
    write(tmpdir_path, "a.txt", "1 0 0 300\n2 1 nan 301\n3 1 1 302\n")
    df = read_readings(spark, tmpdir_path)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value#") + plan.count("split(regexp_replace(value#") <= len(SEPARATORS)
    assert sorted(r["node_number"] for r in df.collect()) == ["1", "3"]
    dec = separator_decisions(read_lines(spark, tmpdir_path))
    assert "SortAggregate" not in dec._jdf.queryExecution().executedPlan().toString()


def test_listing_tasks_are_set_back(spark, tmpdir_path):
    from heatwise.sources.files import LISTING, read_lines
    before = spark.conf.get(LISTING)
    write(tmpdir_path, "a.txt", "1 0 0 300\n")
    assert read_lines(spark, tmpdir_path).count() == 1 and spark.conf.get(LISTING) == before
