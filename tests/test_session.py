from types import SimpleNamespace

import pytest

from riskframe.session import durable, require_small, run_together, shared_dir


def session_like(configured=None, context_dir=None, master="spark://host"):
    context = SimpleNamespace(getCheckpointDir=lambda: context_dir, master=master, applicationId="app-x")
    return SimpleNamespace(conf={"spark.checkpoint.dir": configured}, sparkContext=context)


def test_shared_folder():
    assert shared_dir(session_like("s3://bucket/tmp/")) == "s3://bucket/tmp"
    assert shared_dir(session_like(None, "hdfs://x/y")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        shared_dir(session_like())
    local = shared_dir(session_like(master="local[2]"))
    assert local and local == shared_dir(session_like(master="local[2]"))


def test_written_tables_are_partitioned(spark):
    table = durable(spark.range(10).selectExpr("id", "int(id % 2) AS fold"), "t", "fold")
    one = table.where("fold = 1")
    assert one.count() == 5 and table.columns == ["id", "fold"]
    assert "PartitionFilters: [isnotnull(fold" in one._jdf.queryExecution().executedPlan().toString()


def test_lineage_is_cut(spark):
    plan = durable(spark.range(10).groupBy("id").count())._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "Exchange" not in plan


def test_size_checks():
    assert require_small([1], "x") == [1]
    for rows in ([], list(range(20))):
        with pytest.raises(ValueError):
            require_small(rows, "x", 10)


def test_jobs_run_together(spark):
    jobs = [lambda i=i: spark.range(i).count() for i in range(5)]
    assert run_together(spark, jobs, 3) == run_together(spark, jobs, 1) == [0, 1, 2, 3, 4]
    with pytest.raises(ZeroDivisionError):
        run_together(spark, [lambda: 1, lambda: 1 // 0], 2)
