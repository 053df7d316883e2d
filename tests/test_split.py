import hashlib

import pytest
from pyspark.sql import functions as F

from riskframe.functions import ranking
from riskframe.operators import split


@pytest.fixture(scope="module")
def people(spark):
    """7,043 rows with 1,869 positives, the published proportions."""
    return spark.range(7043).withColumn("y", (F.col("id") < 1869).cast("int"))


def test_published_sizes(people):
    s = split.stratified_split(people, "id", "y")
    got = {(r["split"], r["y"]): r["count"] for r in s.groupBy("split", "y").count().collect()}
    size = lambda n: got[(n, 0)] + got[(n, 1)]
    assert (size("train"), size("val"), size("test")) == (3451, 1479, 2113)
    assert (got[("test", 1)], got[("test", 0)]) == (561, 1552)
    assert got[("val", 1)] == 392 and got[("train", 1)] == 916


def test_split_ignores_order_and_partitions(people):
    a = split.stratified_split(people, "id", "y")
    b = split.stratified_split(people.repartition(7).orderBy(F.desc("id")), "id", "y")
    assert a.exceptAll(b).isEmpty()
    other = split.stratified_split(people, "id", "y", seed=7)
    assert not a.exceptAll(other).isEmpty()
    assert all(r["ok"] for r in split.leakage_audit(a, "id").collect())


def test_split_is_a_projection(people):
    plan = split.stratified_split(people, "id", "y")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("small", [1, 5, 100_000])
def test_hash_cuts_are_exact_at_any_depth(spark, small):
    df = spark.range(2000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    ranks = {0: [0, 1, 500, 1333], 1: [17, 667]}
    got = ranking.hash_cuts(df, "id", "y", 42, ranks, small=small)
    rows = df.select("y", ranking.key_hash("id", 42).alias("h")).collect()
    for c, wanted in ranks.items():
        order = sorted(r["h"] for r in rows if r["y"] == c)
        assert got[c] == [order[r - 1] if r else "" for r in wanted]


def test_folds(people):
    f = split.stratified_folds(people, "id", "y", 5)
    counts = {}
    for r in f.groupBy("fold", "y").count().collect():
        counts.setdefault(r["y"], []).append(r["count"])
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in counts.values())
    assert f.where("fold is null").isEmpty()
    with pytest.raises(ValueError):
        split.stratified_folds(people, "id", "y", 1)


def test_tiny_classes(spark):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(7)], "id long, y int")
    f = split.stratified_folds(df, "id", "y", 3).collect()
    assert sorted({r["fold"] for r in f}) == [0, 1, 2]
    with pytest.raises(Exception, match="label"):
        split.stratified_split(df.withColumn("y", F.lit(2)), "id", "y")


def test_allocate():
    assert split.allocate(2113, {0: 5174, 1: 1869}) == {0: 1552, 1: 561}
    assert sum(split.allocate(10, {0: 7, 1: 7, 2: 7}).values()) == 10


def test_audit_finds_leaks(frame):
    s = frame("id int, split string", (1, "a"), (1, "b"), (2, None), (3, "a"))
    got = {r["check"]: r["bad_keys"] for r in split.leakage_audit(s, "id").collect()}
    assert got == {"repeated": 1, "overlap": 1, "unassigned": 1}


def test_samples(people):
    a = {r["id"] for r in split.sample_rows(people, "id", 500).collect()}
    b = {r["id"] for r in split.sample_rows(people.repartition(5), "id", 500).collect()}
    assert len(a) == 500 and a == b
    assert [r["id"] for r in split.first_rows(people, ["id"], 3).collect()] == [0, 1, 2]


def test_repeated_keys_stay_together(spark):
    """A hot key with half of the rows: whole keys share a block, the other sizes are near."""
    rows = [(0 if i % 2 else 1 + i % 100, i % 3 == 0) for i in range(1000)]
    df = spark.createDataFrame([(k, int(y)) for k, y in rows], "k long, y int")
    folds = split.stratified_folds(df, "k", "y", 5)
    assert folds.count() == 1000
    assert folds.groupBy("k", "y").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    parts = split.stratified_split(df.where("k > 0"), "k", "y", 0.3, 0.3)
    sizes = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert abs(sizes["test"] - 150) <= 20 and abs(sizes["val"] - 105) <= 20


@pytest.mark.parametrize("cut", [split.stratified_folds, split.stratified_split])
def test_null_keys_are_named(spark, cut):
    df = spark.createDataFrame([(1, 0), (None, 1), (3, 1)], "k long, y int")
    with pytest.raises(ValueError, match="key column k is NULL in 1 rows"):
        cut(df, "k", "y")


def test_sample_by_counts_takes_the_same_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i // 3 if i > 90 else i, i) for i in range(600)] + [(None, -1)], "id long, row long")
    hashes = lambda rows: sorted(hashlib.md5(f"42-{r['id']}".encode()).hexdigest() for r in rows)
    for n in (1, 50, 333):
        few = split.sample_rows(df, "id", n).collect()
        monkeypatch.setattr(split, "TOP_ROWS", 0)
        many = split.sample_rows(df, "id", n).collect()
        monkeypatch.undo()
        assert hashes(few) == hashes(many) and len(many) == n
        assert len({r["row"] for r in many}) == n and None not in {r["id"] for r in many}
    monkeypatch.setattr(split, "TOP_ROWS", 0)
    assert split.sample_rows(df, "id", 5_000).count() == 600
