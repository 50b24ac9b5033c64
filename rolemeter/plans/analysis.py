"""The full analysis of resumes against role profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolemeter.functions.scoring import WEAK_BELOW, gap, tier
from rolemeter.operators import dimensions
from rolemeter.operators.dimensions import is_small
from rolemeter.operators.embeddings import model_similarities
from rolemeter.operators.gaps import FOCUS_SKILLS, MISSING_SHOWN, heaviest, names, weak_column
from rolemeter.operators.identity import DOC_KEY, document_columns, identified, join_documents
from rolemeter.operators.layout import stored
from rolemeter.operators.long_form import score_rows
from rolemeter.operators.skills import ROLE_PART, Semantic, readiness_column, role_rows, score_skills
from rolemeter.operators.study_plan import with_study_plan

ANALYSED = [DOC_KEY, "resume_id", "target_role", "skills", "readiness_score", "gaps", "readiness_tier", "n_skills", "n_gaps"]


def roll_up(scored: DataFrame) -> DataFrame:
    """Add readiness, tier, ranked gaps and counts to `resume_id, target_role, skills`."""
    rolled = scored.select("*", readiness_column().alias("readiness_score"), weak_column().alias("gaps"))
    return rolled.select(
        "*",
        tier(F.col("readiness_score")).alias("readiness_tier"),
        F.size("skills").cast("bigint").alias("n_skills"),
        F.size("gaps").cast("bigint").alias("n_gaps"),
    )


def fits_rows(role_skills: DataFrame, semantic: Semantic) -> bool:
    """Whether the role table can be broadcast, counting the query vector every skill gets."""
    room = dimensions.MAX_BROADCAST_BYTES // (8 * semantic.dim)
    return is_small(role_skills, max_rows=min(dimensions.MAX_BROADCAST_ROWS, room))


def analyse(
    resumes: DataFrame,
    role_skills: DataFrame,
    semantic: Semantic = Semantic(),
    similarities: DataFrame | None = None,
    small: bool | None = None,
) -> DataFrame:
    """`resume_id, target_role, skills, readiness_score, gaps, readiness_tier, n_skills, n_gaps`, and a `doc_key` the resumes have.

    One row per resume whose role is known, whatever its id: everything is local to a resume's row. With
    a role table of proven small size, which is broadcast, nothing is shuffled, and a stream
    works as well. A larger one is joined by one salted shuffle. Only where a role has more than
    ROLE_PART skills are its parts put together again, by a key of the row's own. `small` tells
    whether the role table may be broadcast; by default it is measured.
    """
    if fits_rows(role_skills, semantic) if small is None else small:
        return roll_up(score_skills(resumes, role_rows(role_skills, semantic), semantic, similarities))
    roles = stored(role_rows(role_skills, semantic, ROLE_PART), "roles")
    if roles.where("part > 0").isEmpty():
        return roll_up(score_skills(resumes, roles.drop("part"), semantic, similarities, small=False))
    scored = score_skills(identified(resumes), roles, semantic, similarities, small=False)
    names = document_columns(scored)
    ordered = F.array_sort(F.collect_list(F.struct("part", "skills")))
    whole = scored.groupBy(*names).agg(F.flatten(F.transform(ordered, lambda p: p.skills)).alias("skills"))
    return roll_up(whole.select(*document_columns(resumes), "skills"))


def analyse_with_model(
    resumes: DataFrame, role_skills: DataFrame, embed: Callable, semantic: Semantic, vectors: str | None = None
) -> DataFrame:
    """`analyse` with the vectors of a model, see `operators.embeddings`. Every row is a document of its own, whatever its id."""
    keyed = identified(resumes)
    similarities = model_similarities(keyed, role_skills, embed, semantic.chunk_size, vectors)
    return analyse(keyed, role_skills, semantic, similarities).select(*[c for c in ANALYSED if c != DOC_KEY or DOC_KEY in resumes.columns])


def with_focus(analysed: DataFrame) -> DataFrame:
    """Add the first three gaps and the three heaviest skills by name."""
    return analysed.select(
        "*",
        names(F.col("gaps")).alias("gap_names"),
        names(heaviest(F.col("skills"))).alias("top_names"),
    )


def with_plan(analysed: DataFrame, curriculum: DataFrame) -> DataFrame:
    """Add the four-week study plan."""
    return with_study_plan(with_focus(analysed), curriculum)


def analyse_large(
    segments: DataFrame, role_skills: DataFrame, semantic: Semantic = Semantic(), small: bool | None = None
) -> DataFrame:
    """Skill scores of documents and role tables of any size, one row per document and skill.

    Same values as `analyse`, with the `doc_key` of the document. Several results are derived from
    these rows, so write them to a table first and pass that to the functions below.
    """
    return score_rows(segments, role_skills, semantic, small=fits_rows(role_skills, semantic) if small is None else small)


def _own(scores: DataFrame) -> list[str]:
    return [c for c in (DOC_KEY, "resume_id", "role") if c in scores.columns]


def readiness_of(scores: DataFrame, documents: DataFrame) -> DataFrame:
    """Readiness, tier and counts from skill scores in rows.

    `documents` holds `resume_id, target_role` of all resumes whose role is known, or rather their `doc_key`
    too, without which rows of one id and role are one; one whose role has no skills gets 0.0, as in `analyse`.
    """
    ordered = F.array_sort(F.collect_list(F.struct("skill_ord", "score", "weight")))
    own = _own(scores)
    rolled = scores.groupBy(*own).agg(
        ordered.alias("skills"),
        F.count(F.lit(1)).alias("n_skills"),
        F.count_if(F.col("score") < WEAK_BELOW).alias("n_gaps"),
    ).withColumnRenamed("role", "target_role")
    none = F.array().cast(rolled.schema["skills"].dataType)
    asked = documents.select(*document_columns(documents))
    asked = asked if DOC_KEY in asked.columns else asked.distinct()
    zero = F.lit(0).cast("bigint")
    rolled = join_documents(asked, rolled).select(
        "resume_id", F.col("target_role").alias("role"), F.coalesce("skills", none).alias("skills"),
        F.coalesce("n_skills", zero).alias("n_skills"), F.coalesce("n_gaps", zero).alias("n_gaps"),
    )
    scored = rolled.withColumn("readiness_score", readiness_column())
    return scored.select(
        "resume_id", "role", "readiness_score", tier(F.col("readiness_score")).alias("readiness_tier"), "n_skills", "n_gaps"
    )


def gaps_of(scores: DataFrame) -> DataFrame:
    """Weak skills with their priority from skill scores in rows."""
    order = Window.partitionBy(*_own(scores)).orderBy(F.desc("weight"), "score", "skill_ord")
    weak = scores.where(F.col("score") < WEAK_BELOW)
    return weak.select(
        "resume_id", "role", F.row_number().over(order).alias("priority"), "skill_ord", "skill", "score", "weight",
        gap(F.col("score")).alias("gap"), "level", "matched_keywords",
        F.slice("missing_keywords", 1, MISSING_SHOWN).alias("missing_keywords"),
    )


def plan_of(scores: DataFrame, curriculum: DataFrame) -> DataFrame:
    """Study plans from skill scores in rows: `resume_id, target_role, study_plan`.

    What is grouped by document is its six first skills at most, by the two orders.
    """
    own = _own(scores)
    by_weight = Window.partitionBy(*own).orderBy(F.desc("weight"), "skill_ord")
    by_gap = Window.partitionBy(*own).orderBy(F.col("score") >= WEAK_BELOW, F.desc("weight"), "score", "skill_ord")
    ranked = scores.select(*own, "skill", "score", F.row_number().over(by_weight).alias("top"), F.row_number().over(by_gap).alias("weak"))
    ranked = ranked.withColumn("weak", F.when(F.col("score") < WEAK_BELOW, F.col("weak")))

    def first_three(place: str):
        chosen = F.collect_list(F.when(F.col(place) <= FOCUS_SKILLS, F.struct(place, "skill")))
        return F.transform(F.array_sort(chosen), lambda r: r.skill)

    focused = ranked.where((F.col("top") <= FOCUS_SKILLS) | (F.col("weak") <= FOCUS_SKILLS)).groupBy(*own).agg(
        first_three("top").alias("top_names"), first_three("weak").alias("gap_names")
    )
    return with_study_plan(focused.select("resume_id", F.col("role").alias("target_role"), "top_names", "gap_names"), curriculum)
