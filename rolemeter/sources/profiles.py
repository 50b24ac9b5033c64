"""Role profiles and curriculum tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemeter import schemas
from rolemeter.functions.text import strip

DEFAULT_WEIGHT = 0.1
QUERY_KEYWORDS = 6


def _roles(documents: DataFrame, column: str) -> DataFrame:
    """`role, role_ord, profile`; of a repeated role the last profile, at the place of the first.

    Malformed JSON is an error: without its roles every resume would be refused.
    """
    parsed = documents.select(F.from_json(F.col(column), schemas.PROFILE_JSON, {"mode": "FAILFAST"}).alias("profiles"))
    return (
        parsed.select(F.posexplode("profiles").alias("pos", "role", "profile"))
        .groupBy("role")
        .agg(F.min("pos").alias("role_ord"), F.max_by("profile", "pos").alias("profile"))
    )


def profiles_from_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """Flatten role-profile JSON objects to one row per role skill, with defaults.

    File order is kept in `role_ord` and `skill_ord`. Of a repeated key the last value counts,
    at the place of the first. A role without skills keeps one row with a null skill.
    """
    skills = (
        _roles(documents, column)
        .select("role", "role_ord", F.posexplode_outer("profile.skills").alias("pos", "skill", "info"))
        .groupBy("role", "role_ord", "skill")
        .agg(F.min("pos").alias("skill_ord"), F.max_by("info", "pos").alias("info"))
    )
    return skills.select(
        "role",
        "role_ord",
        "skill",
        "skill_ord",
        F.coalesce(F.col("info.weight").cast("double"), F.lit(DEFAULT_WEIGHT)).alias("weight"),
        F.coalesce("info.description", F.lit("")).alias("description"),
        F.coalesce("info.keywords", F.array().cast("array<string>")).alias("keywords"),
    )


def role_payloads(documents: DataFrame, column: str = "value") -> DataFrame:
    """`role, title, profile`: every role with its profile as JSON, absent fields left out."""
    typed = F.transform_values("profile.skills", lambda name, info: F.struct(
        info.weight.cast("double").alias("weight"), info.description.alias("description"), info.keywords.alias("keywords")
    ))
    body = F.struct("profile.title", "profile.description", typed.alias("skills"))
    return _roles(documents, column).select("role", "profile.title", F.to_json(body).alias("profile"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Role skills of a JSON file that holds one object keyed by role."""
    return profiles_from_json(spark.read.text(path, wholetext=True))


def read_curriculum(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Learning material, one row per skill."""
    return spark.read.schema(schemas.CURRICULUM).format(fmt).load(path)


def query_text(role_skills: DataFrame) -> DataFrame:
    """Add the text a skill is embedded as."""
    return role_skills.withColumn(
        "query_text",
        F.concat(
            "skill", F.lit(": "), "description", F.lit(". Keywords: "),
            F.array_join(F.slice("keywords", 1, QUERY_KEYWORDS), ", "), F.lit("."),
        ),
    )


def role_listing(role_skills: DataFrame) -> DataFrame:
    """One row per role, `role_ord` for its place in the file, with how many skills it has and what they weigh."""
    return role_skills.groupBy("role", "role_ord").agg(
        F.count("skill").alias("n_skills"),
        F.coalesce(F.sum(F.when(F.col("skill").isNotNull(), F.size("keywords"))), F.lit(0)).alias("n_keywords"),
    )


def requested_role(name):
    """A requested role name as it is looked up: trimmed."""
    return strip(name)
