import pytest

from riskframe.operators import clean, profile


def cats(frame, *values):
    df = frame("c string", *[(v,) for v in values])
    return [r["c"] for r in clean.clean(df).collect()]


def test_missing_rules(frame):
    assert cats(frame, "a", None, "b") == ["a", None, "b"]
    assert cats(frame, "a", "   ", "b") == ["a", None, "b"]
    assert cats(frame, "  a  ", "b", "c  ") == ["a", "b", "c"]
    assert cats(frame, "a", "nan", "b") == ["a", "nan", "b"]
    assert cats(frame, "\t\n", " x ", "\x1f y") == [None, "x", "y"]


def totals(frame, *rows, schema="tenure int, total string"):
    df = clean.clean(frame(schema, *rows), ["total"], {"total": "tenure"})
    return [r["total"] for r in df.collect()]


def test_zero_rule(frame):
    assert totals(frame, (0, "   "), (0, " "), (12, "1000.0")) == [0.0, 0.0, 1000.0]
    assert totals(frame, (0, "500.0"), (0, "0.0")) == [500.0, 0.0]
    assert totals(frame, (12, "   ")) == [None]
    assert totals(frame, (0, None)) == [None]
    assert totals(frame, (0, None), (0, 2.5), schema="tenure int, total double") == [None, 2.5]


def test_text_to_number(frame):
    texts = ["1.5", " 7 ", "-2e3", ".5", "5.", "1.5d", "abc", "nan", "1,000", "0x10", "+3", ""]
    got = totals(frame, *[(1, t) for t in texts])
    assert got == [1.5, 7.0, -2000.0, 0.5, 5.0, None, None, None, None, None, 3.0, None]


def test_drop_and_order(frame):
    df = clean.clean(frame("z string, id string, a string", ("1", "2", "3")), drop=["id"])
    assert df.columns == ["a", "z"]


def test_dataset_checks(frame):
    good = frame("t string", ("Yes",), ("No",))
    assert clean.assert_dataset(good, "t") is good
    for rows in ([("Yes",), (None,)], [("Maybe",)]):
        with pytest.raises(ValueError, match="target"):
            clean.assert_dataset(frame("t string", *rows), "t")
    with pytest.raises(ValueError, match="not_empty"):
        clean.assert_dataset(good.where("false"), "t")
    labelled = clean.with_label(frame("t string, x int", ("Yes", 1), ("No", 2), ("?", 3)), "t")
    assert [r["y"] for r in labelled.collect()] == [1, 0, None]


def test_profile(frame):
    df = frame("a double, b string", (1.0, "x"), (2.0, "x"), (3.0, "y"), (4.0, None), (1.0, "x"))
    assert profile.duplicate_rows(df).first()[0] == 1
    assert [tuple(r) for r in profile.missing_counts(df).collect()] == [("b", 1)]
    d = profile.describe_numeric(df, ["a"]).first()
    assert (d["count"], d["q50"], d["min"], d["max"]) == (5, 2.0, 1.0, 4.0) and d["std"] == pytest.approx(1.30384, abs=1e-5)
    c = profile.categorical_values(df, ["b"], top=1).collect()
    assert [tuple(r) for r in c] == [("b", 1, "x", 3, 2, 4, 1)]
    corr = {(r["a"], r["b"]): r["corr"] for r in profile.correlation(df.withColumn("d", df.a * -2), ["a", "d"]).collect()}
    assert corr[("a", "d")] == pytest.approx(-1) and len(corr) == 4


def test_top_values_are_limited_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("string(id) AS a", "string(id % 3) AS b")
    out = profile.categorical_values(df, ["a", "b"])
    initial = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in initial and "Partial" in initial and "CartesianProduct" not in initial


def test_value_share_by_group_without_window(spark):
    rows = [("a", "x"), ("a", "x"), ("a", None), (None, "x"), (None, "y"), ("b", "z")]
    df = spark.createDataFrame(rows, "g string, v string")
    got = {(r["g"], r["value"]): (r["count"], r["percent"]) for r in profile.value_share(df, "v", ["g"]).collect()}
    assert got == {("a", "x"): (2, 66.67), ("a", None): (1, 33.33), (None, "x"): (1, 50.0), (None, "y"): (1, 50.0), ("b", "z"): (1, 100.0)}
    whole = profile.value_share(df, "v")
    assert {r["value"]: r["percent"] for r in whole.collect()} == {"x": 50.0, "y": 16.67, "z": 16.67, None: 16.67}
    assert profile.value_share(df.where("false"), "v").collect() == []
    for out in (whole, profile.value_share(df, "v", ["g"])):
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
