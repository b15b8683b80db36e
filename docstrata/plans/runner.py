"""The stages of a project run in their order, each skipped where its input is what it was."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.state import fingerprint
from ..sinks import exists, write_projects

#: The stages in order of dependence.
STAGES = ["ingest", "parse", "extract", "embed", "timeline", "phases", "graph", "direction", "gaps", "view", "report"]

Stage = Callable[[], DataFrame]


def run_stages(stages: dict[str, Stage], before: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """project_id, stage, place, rows, fingerprint, action for each project and stage. A stage gives rows with
    project_id and line, the text by which a row is known; before (project_id, stage, fingerprint) says what the
    last run wrote. action: run, or skip where the fingerprint is unchanged. keep writes a table to the shared
    folder, so that a later stage starts from what an earlier one wrote."""
    out = []
    for place, name in enumerate(STAGES):
        if name in stages:
            rows = keep(stages[name]())
            counts = rows.groupBy("project_id").agg(F.count("*").alias("rows"))
            prints = fingerprint(rows, ["project_id"], F.col("line"))
            out.append(counts.join(prints.hint("merge"), "project_id").select("project_id", F.lit(name).alias("stage"), F.lit(place).alias("place"), "rows", "fingerprint"))
    every = reduce(DataFrame.unionByName, out)
    old = before.select("project_id", "stage", F.col("fingerprint").alias("was"))
    action = F.when(F.col("was") == F.col("fingerprint"), "skip").otherwise("run")
    return every.join(old.hint("merge"), ["project_id", "stage"], "left").withColumn("action", action).drop("was")


@dataclass(frozen=True)
class Step:
    """A stage that keeps its rows in a table by project. inputs gives project_id and line, the text of what the stage
    reads, without running it; run gives the rows of the projects (project_id) that it is given."""

    name: str
    inputs: Callable[[], DataFrame]
    run: Callable[[DataFrame], DataFrame]
    version: str = "v1"


LEDGER = "run int, place int, project_id int, stage string, status string, fingerprint string, message string"


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/ledger"
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def run_steps(spark: SparkSession, steps: list[Step], root: str, keep: Callable[[DataFrame], DataFrame], on_start: Callable[[str], None] | None = None) -> DataFrame:
    """Runs steps in their order and returns this run's part of the ledger: status is done, skip or error.

    Before a step, the fingerprints of its projects' inputs are compared with those that the ledger below root has as
    done; equal ones are skipped, and a step without other projects isn't run at all. What a step gives replaces these
    projects' partitions of the table root/name; projects that have no input any more lose theirs. The ledger gets a
    step's rows only after its table is written, so a step that was broken off runs again. A step that fails
    is entered as error and ends the run; what was done before stays, and the next run goes on there."""
    ledger = read_ledger(spark, root)
    number = 1 + (ledger.agg(F.max("run")).first()[0] or 0)
    for place, step in enumerate(steps):
        if on_start:
            on_start(step.name)
        now = keep(fingerprint(step.inputs(), ["project_id"], F.col("line"), step.version))
        past = read_ledger(spark, root).where((F.col("stage") == step.name) & F.col("status").isin("done", "gone"))
        last = past.groupBy("project_id").agg(F.max_by("status", "run").alias("was"), F.max_by("fingerprint", "run").alias("seen")).where("was = 'done'")
        both = keep(now.join(last.hint("merge"), "project_id", "full_outer").select("project_id", "fingerprint", F.when(F.col("fingerprint").isNull(), "gone").when(F.col("fingerprint").eqNullSafe(F.col("seen")), "skip").otherwise("done").alias("status")))
        changed = keep(both.where("status <> 'skip'"))
        error = None
        if not changed.isEmpty():
            spark.sparkContext.setJobGroup(f"step {step.name}", f"run {number}")
            try:
                rows = keep(step.run(changed.where("status = 'done'").select("project_id")))  # a step runs once, also if its rows are read twice
                write_projects(rows, f"{root}/{step.name}", changed)
            except Exception as e:  # whatever a step raises ends the run
                error = f"{type(e).__name__}: {e}"[:2000]
            finally:
                spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        status = F.when(F.col("status") == "skip", "skip").otherwise(F.lit("error")) if error else F.col("status")
        entry = both.select(F.lit(number).alias("run"), F.lit(place).alias("place"), "project_id", F.lit(step.name).alias("stage"), status.alias("status"), "fingerprint", F.when(status == "error", F.lit(error)).cast("string").alias("message"))
        entry.write.mode("append").parquet(f"{root}/ledger")
        if error:
            break
    return read_ledger(spark, root).where(F.col("run") == number)
