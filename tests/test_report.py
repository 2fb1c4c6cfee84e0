def test_report_gathers_no_group_in_an_array(spark, small):
    from quern.plans.catalogue import QUERIES

    plan = QUERIES["eval_report"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_report_takes_the_upper_median_and_keeps_null_groups(spark, tmp_path):
    from quern.plans.catalogue import QUERIES

    rows = [("a", "x", 1), ("a", "x", 1), ("a", None, 5), ("a", "x", 9), (None, "x", 2)]
    spark.createDataFrame(rows, "lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(str(tuple(r)) for r in QUERIES["eval_report"](spark, str(tmp_path)).collect())
    want = [("a", None, 4, 4.0, 1, 9, 5), (None, None, 1, 2.0, 2, 2, 2), (None, "x", 4, 3.25, 1, 9, 2), (None, None, 1, 5.0, 5, 5, 5), (None, None, 5, 3.6, 1, 9, 2)]
    assert got == sorted(map(str, want))
