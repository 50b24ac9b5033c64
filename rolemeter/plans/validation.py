"""Which resumes can be analysed, and why the others cannot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.functions.text import strip
from rolemeter.operators.dimensions import lookup_join
from rolemeter.operators.identity import document_columns

MIN_ANALYSIS_CHARS = 10

# The messages a refused analysis is reported with.
TOO_SHORT = "Resume text is empty or too short for meaningful analysis."
UNKNOWN_ROLE = "Invalid target role '%s'. Available roles are: [%s]"
NO_SKILLS = "Analysis failed: role has no skills"


def long_enough(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= MIN_ANALYSIS_CHARS


def role_names(role_skills: DataFrame) -> DataFrame:
    """One row: the quoted role names in file order, as the message for an unknown role lists them."""
    roles = role_skills.select("role_ord", F.concat(F.lit("'"), "role", F.lit("'")).alias("quoted")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct("role_ord", "quoted")))
    return roles.agg(F.array_join(F.transform(ordered, lambda r: r.quoted), ", ").alias("listed"))


def with_listing(rejects: DataFrame, role_skills: DataFrame) -> DataFrame:
    """Rejects with the full message, for those that report them.

    Inside the plans a reject of an unknown role names only that role: the listing is the same in
    every row and as long as the role table.
    """
    full = F.concat("reason", F.lit(UNKNOWN_ROLE.partition("%s'")[2].partition("%s")[0]), role_names(role_skills).scalar(), F.lit("]"))
    return rejects.withColumn("reason", F.when(F.col("stage") == "role", full).otherwise(F.col("reason")))


def role_sizes(role_skills: DataFrame) -> DataFrame:
    return role_skills.groupBy("role").agg(F.count("skill").alias("role_skills"))


def known_roles(resumes: DataFrame, role_skills: DataFrame, small: bool | None = None) -> DataFrame:
    """Resumes whose target role exists."""
    roles = role_sizes(role_skills).select(F.col("role").alias("target_role"))
    return lookup_join(resumes, roles, "target_role", "left_semi", small)


def resume_rejects(resumes: DataFrame, role_skills: DataFrame, small: bool | None = None) -> DataFrame:
    """`resume_id, target_role, stage, reason`, and a `doc_key` they have, of resumes that are too short, ask for an unknown role, or for
    a role without skills, for which there is no plan. First check wins. `with_listing` completes
    the message about unknown roles.
    """
    roles = role_sizes(role_skills).withColumnRenamed("role", "target_role")
    looked_up = lookup_join(resumes, roles, "target_role", "left", small)
    own = document_columns(resumes)
    checked = looked_up.select(
        *own,
        F.when(~long_enough(F.col("text")), F.struct(F.lit("analyse").alias("stage"), F.lit(TOO_SHORT).alias("reason")))
        .when(
            F.col("role_skills").isNull(),
            F.struct(
                F.lit("role").alias("stage"),
                F.format_string(UNKNOWN_ROLE.partition("'.")[0] + "'", F.coalesce("target_role", F.lit(""))).alias("reason"),
            ),
        )
        .when(F.col("role_skills") == 0, F.struct(F.lit("plan").alias("stage"), F.lit(NO_SKILLS).alias("reason")))
        .alias("refusal"),
    )
    return checked.where(F.col("refusal").isNotNull()).select(*own, "refusal.stage", "refusal.reason")
