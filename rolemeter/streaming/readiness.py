"""Scoring of newly arriving documents.

Where the role table fits a broadcast, scoring is local to a document: the batch expressions run
unchanged on a stream, and the file sink with its checkpoint writes every document exactly once,
also across restarts. `run_stream` also writes what was refused, and takes role tables of any
size: each batch is then a batch job, written under its number, so a repeated one replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolemeter.operators.dimensions import lookup_join
from rolemeter.operators.identity import DOC_KEY, identified, join_documents
from rolemeter.operators.layout import stored
from rolemeter.operators.skills import Semantic
from rolemeter.plans.analysis import analyse, fits_rows, with_plan
from rolemeter.plans.intake import intake, readiness_of_files
from rolemeter.plans.validation import long_enough, resume_rejects, with_listing


def score_stream(
    arriving: DataFrame,
    role_skills: DataFrame,
    semantic: Semantic = Semantic(),
    curriculum: DataFrame | None = None,
) -> DataFrame:
    """The batch analysis of a stream of `resume_id, target_role, text`, as a stream.

    Only for role tables that fit a broadcast; `run_stream` takes the others.
    """
    if not fits_rows(role_skills, semantic):
        raise ValueError("the role table is too large to score row by row; use run_stream")
    scored = analyse(arriving, role_skills, semantic)
    return scored if curriculum is None else with_plan(scored, curriculum)


def write_stream(
    scored: DataFrame, folder: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append scored documents as Parquet; drain what is there and stop unless `every` is given."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(every)).start(folder)


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def run_stream(
    arriving: DataFrame,
    role_skills: DataFrame,
    folder: str,
    checkpoint: str,
    semantic: Semantic = Semantic(),
    curriculum: DataFrame | None = None,
    every: str | None = None,
    arrived: str | None = None,
) -> StreamingQuery:
    """Score arriving `resume_id, target_role, text` and write results and rejects of every batch.

    `folder/results` and `folder/rejects` are Parquet tables with a partition column `batch`. Every
    document is in one of them, and one whose role has no skills in both, as in a batch run.

    With `arrived`, a column that orders arrivals, a resume that arrives again for a role replaces its
    earlier arrival: of a batch only the last is scored, and `latest` reads the last of all batches.
    """

    def outcome(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        if arrived is not None:
            rows = last_arrivals(identified(rows, "arrivals"), arrived)
        accepted = analyse(rows.where(long_enough(F.col("text"))), role_skills, semantic)
        if curriculum is not None:
            accepted = with_plan(accepted, curriculum)
        refused = resume_rejects(rows, role_skills)
        if arrived is None:
            return accepted, refused
        order = rows.select(DOC_KEY, F.col(arrived).alias("arrived"))
        return join_documents(accepted, order, "inner").drop(DOC_KEY), join_documents(refused, order, "inner").drop(DOC_KEY)

    return _by_batch(arriving, outcome, role_skills, folder, checkpoint, every)


def last_arrivals(rows: DataFrame, arrived: str) -> DataFrame:
    """Of the rows of one id and role, nulls being equal, the one that arrived last; the later row of two that came at once.

    Only keys are grouped; rows stay where they are if the keys that stay fit a broadcast.
    """
    last = rows.groupBy("resume_id", "target_role").agg(F.max(F.struct(arrived, DOC_KEY)).alias("last"))
    return lookup_join(rows, stored(last.select(f"last.{DOC_KEY}"), "last-arrivals"), DOC_KEY, "left_semi", spread_by=DOC_KEY)


def latest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Results and rejects of what `run_stream` wrote with `arrived`, of each resume and role the last arrival.

    A resume that was refused last has no result, and one that was accepted last no reject but
    that of a role without skills. No state is kept between batches; a key has as many rows as it
    arrived in batches, and they are reduced before they move.
    """
    tables = [spark.read.parquet(f"{folder}/{name}") for name in ("results", "rejects")]
    place = F.struct("arrived", "batch")
    names = ["resume_id", "target_role"]
    seen = tables[0].select(*names, place.alias("place")).unionByName(tables[1].select(*names, place.alias("place")))
    last = seen.groupBy(*names).agg(F.max("place").alias("last"))
    results, rejects = (
        join_documents(t.withColumn("place", place), last, "inner").where(F.col("place") == F.col("last")).drop("place", "last", "arrived", "batch") for t in tables
    )
    return results, rejects


def run_file_stream(
    arriving: DataFrame,
    role_skills: DataFrame,
    folder: str,
    checkpoint: str,
    extract: Callable[[bytes], list[str]] | None = None,
    semantic: Semantic = Semantic(),
    every: str | None = None,
) -> StreamingQuery:
    """Take in and score arriving files (`path, filename, content, target_role`), see `plans.intake`.

    `folder/results` has their readiness, `folder/rejects` the files refused at any step.
    """

    def outcome(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = intake(rows, role_skills, extract)
        return readiness_of_files(found, role_skills, semantic), found.rejects

    return _by_batch(arriving, outcome, role_skills, folder, checkpoint, every)


def _by_batch(
    arriving: DataFrame,
    outcome: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    role_skills: DataFrame,
    folder: str,
    checkpoint: str,
    every: str | None,
) -> StreamingQuery:
    def write(rows: DataFrame, batch: int) -> None:
        # read once from the source, whatever the branches of the outcome
        accepted, refused = outcome(stored(rows, f"batch-{batch}"))
        for name, part in (("results", accepted), ("rejects", with_listing(refused, role_skills))):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(every)).start()
