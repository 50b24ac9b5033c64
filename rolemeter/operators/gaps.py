"""Weak skills, their priority, and the other rankings of a resume's skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.functions.core import built_once
from rolemeter.functions.scoring import WEAK_BELOW, gap

MISSING_SHOWN = 5
FOCUS_SKILLS = 3


def _ranked(skills: Column, *keys) -> Column:
    """Skills ordered by `keys`, ties in profile order."""
    keyed = F.transform(skills, lambda s: F.struct(
        *[key(s).alias(f"k{i}") for i, key in enumerate(keys)], s.skill_ord.alias("ord"), s.alias("skill")
    ))
    return F.transform(F.array_sort(keyed), lambda k: k.skill)


def weak_skills(skills: Column) -> Column:
    """Skills below the threshold, heaviest first, then lowest score."""
    weak = F.filter(skills, lambda s: s.score < WEAK_BELOW)
    shown = F.transform(weak, lambda s: F.struct(
        s.skill_ord.alias("skill_ord"), s.skill.alias("skill"), s.score.alias("score"), s.weight.alias("weight"),
        gap(s.score).alias("gap"), s.level.alias("level"), s.matched_keywords.alias("matched_keywords"),
        F.slice(s.missing_keywords, 1, MISSING_SHOWN).alias("missing_keywords"),
    ))
    return _ranked(shown, lambda s: -s.weight, lambda s: s.score)


@built_once
def weak_column() -> Column:
    return weak_skills(F.col("skills"))


def heaviest(skills: Column) -> Column:
    """Skills by weight, heaviest first."""
    return _ranked(skills, lambda s: -s.weight)


def strongest(skills: Column) -> Column:
    """Skills by score, highest first."""
    return _ranked(skills, lambda s: -s.score)


def names(skills: Column, limit: int = FOCUS_SKILLS) -> Column:
    return F.transform(F.slice(skills, 1, limit), lambda s: s.skill)


def gap_rows(analysed: DataFrame) -> DataFrame:
    """One row per resume and weak skill, with its priority from 1."""
    return analysed.select(
        "resume_id", F.col("target_role").alias("role"), F.posexplode("gaps").alias("pos", "g")
    ).select("resume_id", "role", (F.col("pos") + 1).alias("priority"), "g.*")
