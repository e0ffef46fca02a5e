import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and {"file_name", "leak_status", "confidence"} <= set(df.columns)


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_no_python_udf_outside_images(spark):
    from conftest import SF001
    for name in ("features_full", "file_labels_six", "roc_auc", "balance_dataset"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name


def _windows_over_single_partition(plan: str) -> list:
    """Window operators whose input exchange is SinglePartition (unpartitioned window)."""
    lines = plan.split("\n")
    bad = []
    for i, ln in enumerate(lines):
        if "Window [" in ln:
            ind = len(ln) - len(ln.lstrip(" :+-"))
            for nxt in lines[i + 1:]:
                if "Exchange" in nxt:
                    if "SinglePartition" in nxt:
                        bad.append(ln.strip()[:120])
                    break
    return bad


def test_no_unpartitioned_window_over_rows(spark):
    from conftest import SF001
    for name in ("temp_percentile_rank", "temp_rolling", "roc_curve", "roc_auc",
                 "balance_dataset", "file_labels_six", "features_full"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert not _windows_over_single_partition(plan), name
