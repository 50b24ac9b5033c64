"""Skill scoring: every skill of the target role against one document.

Two physical forms share the same score expressions. `score_skills` keeps the skills of a role
as one array on a broadcast role row, so scoring a document is local to its row and nothing is
shuffled. `operators.long_form` has one row per document and skill and works for role tables
or documents too large for that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.functions.core import built_once, clip, round_exact
from rolemeter.functions.keywords import flagged, keyword_ratio, partition_keywords, probes
from rolemeter.functions.scoring import MODEL_CEILING, MODEL_FLOOR, blend, calibrate, level
from rolemeter.functions.vectors import (
    any_counts, best_mean, chunk_vectors, dense_counts, only_buckets, sparse_cosine, sparse_vector,
)
from rolemeter.operators.dimensions import lookup_join
from rolemeter.operators.identity import document_columns, join_documents
from rolemeter.operators.layout import computed_once
from rolemeter.sources.profiles import query_text

# Beyond the broadcast bound a role with more skills is as many rows; no row holds a role of any size.
ROLE_PART = 1024


@dataclass(frozen=True)
class Semantic:
    """How texts become vectors, and the similarity range that counts as 0 to 1.

    `provider` is "hashed" (term counts, no model), "given" (similarities computed outside, see
    `operators.embeddings`) or "none" (keywords only).
    """

    provider: str = "hashed"
    dim: int = 256
    floor: float = MODEL_FLOOR
    ceiling: float = MODEL_CEILING
    chunk_size: int = 3


@built_once
def _prepared_columns(dim: int) -> tuple[Column, Column, Column]:
    vector = sparse_vector(F.coalesce("query_text", F.lit("")), dim)
    return probes(F.col("keywords")), vector, dense_counts(F.col("vector.buckets"), dim)


def prepared_skills(role_skills: DataFrame, semantic: Semantic) -> DataFrame:
    """Role skills with keyword probes and, for the hashed provider, their query vector."""
    keyword_probes, vector, counts = _prepared_columns(semantic.dim)
    kept = ["role", "role_ord", "skill", "skill_ord", "weight"]
    return (
        query_text(role_skills)
        .select(*kept, keyword_probes.alias("probes"), vector.alias("vector"))
        .select(*kept, "probes", counts.alias("counts"), F.col("vector.norm").alias("query_norm"))
    )


def role_rows(role_skills: DataFrame, semantic: Semantic, part: int | None = None) -> DataFrame:
    """One row per role with the array of its prepared skills, empty for a role without any.

    With `part` a role has a row for each so many skills, numbered by `part`.
    """
    entry = F.struct("skill_ord", "skill", "weight", "probes", "counts", "query_norm")
    entries = F.collect_list(F.when(F.col("skill").isNotNull(), entry))
    prepared = prepared_skills(role_skills, semantic)
    keys = ["role", "role_ord"]
    if part:
        keys.append("part")
        prepared = prepared.withColumn("part", F.floor(F.coalesce("skill_ord", F.lit(0)) / part))
    rows = prepared.groupBy(*keys).agg(F.array_sort(entries).alias("skills"))
    return rows.withColumn("wanted", any_counts(F.transform("skills", lambda s: s.counts)))


@built_once
def vectors_column(size: int, dim: int) -> Column:
    return chunk_vectors(F.col("text"), size, dim)


def with_vectors(resumes: DataFrame, role_skills: DataFrame, semantic: Semantic) -> DataFrame:
    """Resumes with the `vectors` that scoring needs of a text, for those who score it several times.

    Only buckets that some skill of the role table has are kept; the norms are those of the whole.
    """
    places = role_rows(role_skills, semantic, ROLE_PART).select(F.posexplode("wanted").alias("place", "seen"))
    seen = F.array_sort(F.collect_list(F.struct("place", "seen")))
    wanted = places.groupBy("place").agg(F.bool_or("seen").alias("seen")).agg(F.transform(seen, lambda p: p.seen).alias("wanted"))
    whole = resumes.withColumn("vectors", vectors_column(semantic.chunk_size, semantic.dim))
    relevant = F.transform("vectors", lambda v: only_buckets(v, F.col("wanted")))
    return whole.crossJoin(F.broadcast(wanted)).select(*resumes.columns, relevant.alias("vectors"))


def features(resumes: DataFrame, semantic: Semantic) -> DataFrame:
    """What scoring needs of a document: lower-cased text and, if hashed, chunk vectors, unless it has them (see `with_vectors`)."""
    lowered = F.lower("text").alias("lower_text")
    if semantic.provider != "hashed":
        return resumes.select(*document_columns(resumes), lowered)
    vectors = F.col("vectors") if "vectors" in resumes.columns else vectors_column(semantic.chunk_size, semantic.dim)
    return resumes.select(*document_columns(resumes), lowered, vectors.alias("vectors"))


def hashed_similarity(skill: Column) -> Column:
    """Mean cosine of a prepared skill and the two closest chunks of the row."""
    return best_mean(F.transform(F.col("vectors"), lambda v: sparse_cosine(skill.counts, skill.query_norm, v)))


def _keyword_lists(skills: Column | str, similarity: Callable[[Column], Column]) -> Column:
    """Prepared skills of the row with their keyword lists. Each step binds its values once."""
    looked_up = F.transform(skills, lambda s: F.struct(
        s.skill_ord.alias("skill_ord"), s.skill.alias("skill"), s.weight.alias("weight"),
        F.size(s.probes).alias("n_keywords"),
        partition_keywords(F.col("lower_text"), s.probes).alias("flags"),
        similarity(s).alias("similarity"),
    ))
    return F.transform(looked_up, lambda s: F.struct(
        s.skill_ord.alias("skill_ord"), s.skill.alias("skill"), s.weight.alias("weight"),
        s.n_keywords.alias("n_keywords"), s.similarity.alias("similarity"),
        flagged(s.flags, True).alias("matched"), flagged(s.flags, False).alias("missing"),
    ))


@built_once
def scored_entries(semantic: Semantic) -> Column:
    """Prepared `skills` of the row to scored skills."""
    hashed = semantic.provider == "hashed"
    return finished(_keyword_lists("skills", hashed_similarity if hashed else lambda s: F.lit(0.0)), semantic)


@built_once
def keyword_evidence() -> Column:
    return _keyword_lists("skills", lambda s: F.lit(0.0))


@built_once
def given_entries(semantic: Semantic) -> Column:
    """`evidence` of the row scored with `similarities`, a map from skill to similarity."""
    given = F.transform("evidence", lambda s: F.struct(
        s.skill_ord.alias("skill_ord"), s.skill.alias("skill"), s.weight.alias("weight"), s.n_keywords.alias("n_keywords"),
        F.coalesce(F.try_element_at(F.col("similarities"), s.skill), F.lit(0.0)).alias("similarity"),
        s.matched.alias("matched"), s.missing.alias("missing"),
    ))
    return finished(given, semantic)


def finished(evidence: Column, semantic: Semantic) -> Column:
    """Scores of skills from their keyword lists and similarity."""
    scored = F.transform(evidence, lambda s: F.struct(
        s.skill_ord.alias("skill_ord"), s.skill.alias("skill"), s.weight.alias("weight"),
        round_exact(
            blend(
                calibrate(s.similarity, semantic.floor, semantic.ceiling),
                keyword_ratio(F.size(s.matched), s.n_keywords),
                F.size(s.matched),
            ), 1,
        ).alias("score"),
        s.matched.alias("matched"), s.missing.alias("missing"), s.similarity.alias("similarity"),
    ))
    return F.transform(scored, lambda s: F.struct(
        s.skill_ord.alias("skill_ord"), s.skill.alias("skill"), s.score.alias("score"), s.weight.alias("weight"),
        level(s.score).alias("level"), s.matched.alias("matched_keywords"), s.missing.alias("missing_keywords"),
        round_exact(s.similarity, 3).alias("semantic_similarity"),
    ))


def with_role(rows: DataFrame, roles: DataFrame, small: bool) -> DataFrame:
    """Rows joined to the row (or parts) of the role they ask for.

    Beyond the broadcast bound both sides shuffle, once; rows of one role are dealt by their own numbers, so
    that rows that are all alike are split too.
    """
    if small:
        return rows.join(F.broadcast(roles), F.col("target_role") == F.col("role"), "inner")
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    return lookup_join(dealt, roles.withColumnRenamed("role", "target_role"), "target_role", "inner", False, "_row").drop("_row")


def score_skills(
    resumes: DataFrame, roles: DataFrame, semantic: Semantic, similarities: DataFrame | None = None, small: bool = True
) -> DataFrame:
    """`resume_id, target_role, skills` for resumes whose role is in `roles` (see `role_rows`).

    A `doc_key` of the resumes and the `part` of the roles are kept. `small` tells whether the
    roles may be broadcast. With `similarities` (`resume_id, target_role, similarities`, or by
    `doc_key`), keywords are matched first, so that the join by resume moves short rows and no texts.
    """
    kept = [*document_columns(resumes), *(["part"] if "part" in roles.columns else [])]
    matched = with_role(features(resumes, semantic), roles, small)
    if similarities is None:
        if semantic.provider == "hashed":
            relevant = F.transform("vectors", lambda v: only_buckets(v, F.col("wanted")))
            # once a row, not once a skill
            matched = computed_once(matched.select(*kept, "lower_text", "skills", "wanted", "vectors"), "vectors", relevant)
        return matched.select(*kept, scored_entries(semantic).alias("skills"))
    evidence = matched.select(*kept, keyword_evidence().alias("evidence"))
    return join_documents(evidence, similarities).select(*kept, given_entries(semantic).alias("skills"))


def weighted_mean(skills: Column) -> Column:
    """Weighted mean score, summed in profile order; a total weight of 0 or less counts as 1."""
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("weight"))
    return F.aggregate(
        skills,
        zero,
        lambda acc, s: F.struct(
            (acc.score + s.score * s.weight).alias("score"), (acc.weight + s.weight).alias("weight")
        ),
        lambda acc: acc.score / F.when(acc.weight <= 0, F.lit(1.0)).otherwise(acc.weight),
    )


def readiness(skills: Column) -> Column:
    return round_exact(clip(weighted_mean(skills), 0.0, 100.0), 1)


@built_once
def readiness_column() -> Column:
    return readiness(F.col("skills"))


def skill_rows(scored: DataFrame) -> DataFrame:
    """One row per resume and skill."""
    own = [c for c in document_columns(scored) if c != "target_role"]
    return scored.select(*own, F.col("target_role").alias("role"), F.inline("skills"))


def skill_map(skills: Column) -> Column:
    """Skill breakdown keyed by skill name, in profile order."""
    return F.map_from_entries(F.transform(skills, lambda s: F.struct(
        s.skill.alias("key"),
        F.struct(
            s.score.alias("score"), s.weight.alias("weight"), s.level.alias("level"),
            s.matched_keywords.alias("matched_keywords"), s.missing_keywords.alias("missing_keywords"),
            s.semantic_similarity.alias("semantic_similarity"),
        ).alias("value"),
    )))
