import threading
import time

import pytest
from pyspark.sql import functions as F

from seqflow.plans import dag
from seqflow.plans.program import Cancelled, JobSequence, Program
from seqflow.sources import files


def test_versions_and_contributions(spark):
    p = Program(spark)
    p.define("x", spark.range(4).select(F.col("id").alias("v")))
    p.define("total", spark.createDataFrame([(0,)], "v long"), lambda d: d.agg(F.sum("v").alias("v")))

    @p.task(x="rw")
    def double(x):
        return x.select((F.col("v") * 2).alias("v"))

    @p.task(x="read", total="reduction")
    def add(x):
        return x.agg(F.sum("v").alias("v"))

    add()
    double()
    add()
    add()
    out = p.sync("total", "x")
    assert out["total"].first().v == 6 + 12 + 12
    assert sorted(r.v for r in out["x"].collect()) == [0, 2, 4, 6]
    v = dag.versions(p.accesses().select("task_id", F.col("datum"), "mode"))
    assert {(r.task_id, r.datum): r.version for r in v.collect()}[(3, "x")] == 2
    with pytest.raises(ValueError, match="access mode"):
        p.task(x="sideways")


def test_small_files(spark, tmp_path):
    (tmp_path / "t").write_text("size  time\n 10 0.5\n20   1.5 \n\n")
    rows = files.read_samples(spark, str(tmp_path / "t")).orderBy("size").collect()
    assert [(r.size, r.time) for r in rows] == [(10, 0.5), (20, 1.5)]
    files.write_properties(spark, {"a.b": "1", "c": "x = y"}, str(tmp_path / "p"))
    assert files.read_properties(spark, str(tmp_path / "p")) == {"a.b": "1", "c": "x = y"}
    assert [r.id for r in files.cursor(spark.range(3).orderBy("id"))] == [0, 1, 2]


def test_repeat_save_and_restore(spark):
    p = Program(spark)
    p.define("x", spark.createDataFrame([(1,)], "v long"))

    @p.task(x="RW")
    def double(x):
        return x.select((F.col("v") * 2).alias("v"))

    saved = p.save()
    assert p.repeat(5, lambda k: double(x="x"))["x"].first()["v"] == 32
    p.restore(saved)
    assert p.latest("x").first()["v"] == 1
    with pytest.raises(ValueError):
        p.repeat(-1, lambda k: None)


def test_job_sequence_cancels_what_runs_and_what_follows(spark):
    jobs = JobSequence(spark)
    assert jobs.run(lambda: spark.range(10).count()) == 10
    timer = threading.Timer(2, jobs.cancel)
    timer.start()
    slow = F.udf(lambda x: time.sleep(30) or x, "long")
    began = time.time()
    with pytest.raises(Cancelled):
        jobs.run(lambda: spark.range(8, numPartitions=8).select(slow("id")).collect())
    assert time.time() - began < 25
    with pytest.raises(Cancelled):
        jobs.run(lambda: spark.range(1).count())
    assert spark.range(3).count() == 3
