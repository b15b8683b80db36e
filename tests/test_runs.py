"""Runs that skip, stop and go on, and tables that a broken write leaves as they were."""

import pytest
from pyspark.sql import functions as F

from docstrata import sinks
from docstrata.plans.corpus import written
from docstrata.plans.runner import Step, read_ledger, run_steps

ROWS = "project_id int, artifact_id long, value string"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def held(spark, path):
    return sorted((r.project_id, r.artifact_id, r.value) for r in spark.read.schema(ROWS).parquet(path).collect())


def test_a_step_computes_its_rows_once(spark, tmp_path):
    root, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def looked(value):
        seen.add(1)
        return value != "b"

    rows = table(spark, [(1, 1, "a"), (1, 2, "b"), (2, 3, "c")])
    run_steps(spark, [Step("only", lambda: rows.select("project_id", F.col("value").alias("line")), lambda p: rows.where(looked("value")))], root, written)
    assert held(spark, f"{root}/only") == [(1, 1, "a"), (2, 3, "c")] and seen.value == 3


def test_steps_skip_stop_and_go_on(spark, tmp_path):
    root, ran = str(tmp_path / "t"), []
    given = {"rows": [(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "fail": False}
    line = F.concat_ws("|", "artifact_id", "value").alias("line")
    of = lambda name: spark.read.schema(ROWS).parquet(f"{root}/{name}")

    def step(name, source, change):
        def run(projects):
            ran.append((name, sorted(r.project_id for r in projects.collect())))
            if name == "second" and given["fail"]:
                raise RuntimeError("broken")
            return source().join(projects, "project_id", "left_semi").select("project_id", "artifact_id", change(F.col("value")).alias("value"))

        return Step(name, lambda: source().select("project_id", line), run)

    steps = [step("first", lambda: table(spark, given["rows"]), F.upper), step("second", lambda: of("first"), lambda c: F.concat(c, c)), step("third", lambda: of("second"), lambda c: F.length(c).cast("string"))]
    status = lambda out: {(r.stage, r.project_id): r.status for r in out.collect()}

    out = run_steps(spark, steps, root, written)
    assert set(status(out).values()) == {"done"} and held(spark, f"{root}/second") == [(1, 1, "AA"), (1, 2, "BB"), (2, 3, "CC")]
    ran.clear()
    tracker = spark.sparkContext.statusTracker()
    before = {n: len(tracker.getJobIdsForGroup(f"step {n}")) for n in ("first", "second", "third")}
    assert min(before.values()) > 0
    assert set(status(run_steps(spark, steps, root, written)).values()) == {"skip"} and ran == []
    assert before == {n: len(tracker.getJobIdsForGroup(f"step {n}")) for n in before}  # a skipped step runs no job

    given["rows"] = [(1, 1, "a"), (1, 2, "x"), (2, 3, "c")]
    given["fail"] = True
    out = run_steps(spark, steps, root, written)
    assert status(out) == {("first", 1): "done", ("first", 2): "skip", ("second", 1): "error", ("second", 2): "skip"} and ran == [("first", [1]), ("second", [1])]
    assert "broken" in out.where("status = 'error'").first().message and held(spark, f"{root}/second")[1] == (1, 2, "BB")
    ran.clear()
    given["fail"] = False
    assert status(run_steps(spark, steps, root, written))[("second", 1)] == "done" and ran == [("second", [1]), ("third", [1])]
    assert held(spark, f"{root}/second") == [(1, 1, "AA"), (1, 2, "XX"), (2, 3, "CC")]

    given["rows"] = [(2, 3, "c")]  # a project that is gone loses its rows, once
    assert status(run_steps(spark, steps, root, written))[("third", 1)] == "gone"
    assert held(spark, f"{root}/third") == [(2, 3, "2")] and ("first", 1) not in status(run_steps(spark, steps, root, written))
    assert read_ledger(spark, root).agg(F.max("run")).first()[0] == 6


def test_a_broken_write_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_projects(table(spark, [(1, 1, "a"), (2, 2, "b")]), path)

    @F.udf("string")
    def breaks(value):
        if value == "bad":
            raise ValueError("no")
        return value

    new = table(spark, [(1, 1, "new"), (1, 5, "bad")]).repartition(2).withColumn("value", breaks("value"))
    with pytest.raises(Exception):
        sinks.write_projects(new, path)
    assert held(spark, path) == [(1, 1, "a"), (2, 2, "b")]
    sinks.write_projects(table(spark, [(1, 1, "new")]), path)
    sinks.write_projects(table(spark, [(1, 1, "new")]), path)
    assert held(spark, path) == [(1, 1, "new"), (2, 2, "b")]


def test_upsert_by_artifact(spark, tmp_path):
    path = str(tmp_path / "t")
    keys = lambda *ids: spark.createDataFrame(ids, "project_id int, artifact_id long")
    sinks.upsert_artifacts(table(spark, [(1, 1, "a"), (1, 2, "b"), (2, 3, "c")]), keys((1, 1)), path, written)
    sinks.upsert_artifacts(table(spark, [(1, 2, "x"), (1, 2, "y")]), keys((1, 2), (2, 3)), path, written)
    assert held(spark, path) == [(1, 1, "a"), (1, 2, "x"), (1, 2, "y")]
    assert not sinks.exists(spark, f"{path}/project_id=2")
