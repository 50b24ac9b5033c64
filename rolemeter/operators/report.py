"""Candidate reports and the nested result record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.functions import scoring
from rolemeter.operators.gaps import strongest
from rolemeter.operators.skills import skill_map


def report(analysed: DataFrame) -> DataFrame:
    """One row per resume: readiness against the benchmark, counts, best skill and advice."""
    best = analysed.withColumn("best", F.get(strongest(F.col("skills")), F.lit(0)))
    score = F.col("readiness_score")
    return best.select(
        "resume_id",
        F.col("target_role").alias("role"),
        "readiness_score",
        "readiness_tier",
        scoring.badge(score).alias("badge"),
        scoring.benchmark_delta(score).alias("delta_text"),
        (score - F.lit(scoring.BENCHMARK)).alias("delta"),
        "n_skills",
        "n_gaps",
        F.col("best.skill").alias("strongest_skill"),
        F.col("best.score").alias("strongest_score"),
        scoring.screening_probability(score).alias("screening_probability"),
        scoring.strategy(score).alias("strategy"),
    )


def skill_report(analysed: DataFrame) -> DataFrame:
    """One row per resume and skill in display order, highest score first."""
    ranked = analysed.select(
        "resume_id", F.col("target_role").alias("role"), F.posexplode(strongest(F.col("skills"))).alias("pos", "s")
    )
    return ranked.select(
        "resume_id", "role",
        (F.col("pos") + 1).alias("place"),
        "s.skill", "s.score", "s.level",
        scoring.level_band(F.col("s.score")).alias("level_band"),
        scoring.weight_percent(F.col("s.weight")).alias("weight_percent"),
        scoring.matched_display(F.col("s.matched_keywords")).alias("matched_shown"),
    )


def gap_report(gap_rows: DataFrame) -> DataFrame:
    """Gap rows with the weight in percent and the keywords recommended for review."""
    return gap_rows.select(
        "resume_id", "role", "priority", "skill", "score", "gap",
        scoring.weight_percent(F.col("weight")).alias("weight_percent"),
        scoring.missing_display(F.col("missing_keywords")).alias("review"),
    )


def _without_ord(entries: Column, *fields: str) -> Column:
    return F.transform(entries, lambda s: F.struct(*[s[f].alias(f) for f in fields]))


def responses(planned: DataFrame) -> DataFrame:
    """The five response fields of every resume."""
    return planned.select(
        "resume_id",
        "readiness_score",
        skill_map(F.col("skills")).alias("skill_breakdown"),
        _without_ord(
            F.col("gaps"), "skill", "score", "weight", "gap", "level", "matched_keywords", "missing_keywords"
        ).alias("missing_skills"),
        "readiness_tier",
        "study_plan",
    )


def response_json(planned: DataFrame) -> DataFrame:
    """One JSON document per resume."""
    nested = responses(planned)
    fields = [c for c in nested.columns if c != "resume_id"]
    return nested.select("resume_id", F.to_json(F.struct(*fields)).alias("json"))
