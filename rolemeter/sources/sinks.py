"""Result sinks: flat tables that appear together, or one nested record per resume."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from rolemeter.operators.gaps import gap_rows
from rolemeter.operators.report import response_json
from rolemeter.operators.skills import skill_rows
from rolemeter.operators.study_plan import plan_rows

READINESS = ["resume_id", "target_role", "readiness_score", "readiness_tier", "n_skills", "n_gaps"]
TABLES = ("analysis", "readiness", "skill_scores", "skill_gaps", "study_plan")
MODES = ("errorifexists", "append", "overwrite")
MANIFESTS = "_manifests"


class NotCommitted(FileNotFoundError):
    """There are no results in the folder, or none that a run has finished writing."""


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, f"{folder}/{MANIFESTS}")
    if not files.exists(path):
        return []
    names = [str(x.getPath().getName()) for x in files.listStatus(path)]
    return sorted(n for n in names if n.endswith(".json"))


def committed_runs(spark: SparkSession, folder: str) -> list[str]:
    """The folders of the runs that the newest manifest names."""
    names = _manifests(spark, folder)
    if not names:
        return []
    text = spark.read.text(f"{folder}/{MANIFESTS}/{names[-1]}", wholetext=True).first()[0]
    return json.loads(text)["runs"]


def _commit(spark: SparkSession, folder: str, runs: list[str]) -> None:
    """Write the next manifest under a name of its own and move it into place, which shows all tables at once."""
    names = _manifests(spark, folder)
    number = int(names[-1].partition(".")[0]) + 1 if names else 0
    files, target = _files(spark, f"{folder}/{MANIFESTS}/{number:012d}.json")
    _, staged = _files(spark, f"{folder}/{MANIFESTS}/.{uuid.uuid4().hex}")
    out = files.create(staged, False)
    try:
        out.write(bytearray(json.dumps({"runs": runs, "tables": TABLES}).encode()))
    finally:
        out.close()
    if files.exists(target) or not files.rename(staged, target):
        raise RuntimeError(f"another run has committed to {folder} meanwhile; this one is not shown")


def write_results(planned: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """Write the full analysis once, then the flat tables from what was written; all of them appear together.

    Tables are staged in a folder of the run. A manifest, written last, names the runs that count,
    and `read_results` goes by it: a run that fails between two tables shows none of them, and
    readers of the results before are not disturbed. `append` adds a run, `overwrite` replaces all
    earlier ones. Scoring runs a single time; the flat tables read only the columns they need.
    """
    spark = planned.sparkSession
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    before = committed_runs(spark, folder)
    if before and mode == "errorifexists":
        raise FileExistsError(f"{folder} has results")
    run = f"run-{uuid.uuid4().hex}"
    planned.write.parquet(f"{folder}/{run}/analysis")
    stored = spark.read.schema(planned.schema).parquet(f"{folder}/{run}/analysis")
    flat = (stored.select(*READINESS), skill_rows(stored), gap_rows(stored), plan_rows(stored))
    for name, rows in zip(TABLES[1:], flat, strict=True):
        rows.write.parquet(f"{folder}/{run}/{name}")
    _commit(spark, folder, [*before, run] if mode == "append" else [run])
    return read_results(spark, folder)


def read_results(spark: SparkSession, folder: str, table: str = "analysis") -> DataFrame:
    """One of TABLES, as the last finished run left it."""
    if table not in TABLES:
        raise ValueError(f"table must be one of {TABLES}")
    runs = committed_runs(spark, folder)
    if not runs:
        raise NotCommitted(folder)
    return spark.read.parquet(*[f"{folder}/{run}/{table}" for run in runs])


def drop_replaced(spark: SparkSession, folder: str) -> list[str]:
    """Delete runs that no manifest of now names, finished or not; for when nothing writes or reads the earlier results."""
    runs = committed_runs(spark, folder)
    files, path = _files(spark, folder)
    names = [str(x.getPath().getName()) for x in files.listStatus(path)]
    gone = [n for n in names if n.startswith("run-") and n not in runs]
    for name in gone:
        files.delete(_files(spark, f"{folder}/{name}")[1], True)
    return gone


def write_json(planned: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One JSON line per resume with the five response fields."""
    response_json(planned).select("json").write.mode(mode).text(folder)
