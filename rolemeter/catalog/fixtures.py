"""Role profiles and learning material for the test tables.

The tables hold generated prose, so the skills are made of word pieces that occur in it. The
set covers weight ties, a default weight, a skill and a role without anything in them,
phrases, odd keyword edges and non-ASCII keywords.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemeter.operators.skills import Semantic
from rolemeter.sources.profiles import profiles_from_json

SEMANTIC = Semantic(dim=256, floor=0.05, ceiling=0.45)
MODEL_SEMANTIC = Semantic(provider="given", floor=0.6, ceiling=1.0)

PROFILES = {
    "Role EN": {
        "title": "Role EN",
        "description": "English prose",
        "skills": {
            "Common Words": {
                "weight": 0.30,
                "description": "that with this from tion",
                "keywords": ["that", "with", "this", "from", "ther", "tion"],
            },
            "Mid Words": {
                "weight": 0.20,
                "description": "erst thth thon over",
                "keywords": ["erst", "thth", "thon"],
            },
            "Rare Words": {
                "weight": 0.20,
                "description": "ndsh worthless",
                "keywords": ["ndsh", "worthless", "zzabsent"],
            },
            "Phrases": {
                "weight": 0.20,
                "description": "that the and of",
                "keywords": ["that the", "and of", "of-the", "c++"],
            },
            "No Keywords": {},
        },
    },
    "Role DE": {
        "title": "Role DE",
        "description": "German prose",
        "skills": {
            "Haeufig": {
                "weight": 0.29,
                "description": "sich nicht eine",
                "keywords": ["sich", "nicht", "eine", "enau", "ench"],
            },
            "Endungen": {"weight": 0.29, "description": "keit heit ung", "keywords": ["keit", "heit"]},
            "Selten": {
                "weight": 0.42,
                "description": "verheit erlich",
                "keywords": ["verheit", "erlich", "ersch"],
            },
        },
    },
    "Role FR": {
        "title": "Role FR",
        "description": "French prose",
        "skills": {
            "Frequents": {
                "weight": 0.5,
                "description": "pour dans avec",
                "keywords": ["pour", "dans", "avec", "elle"],
            },
            "Suffixes": {
                "weight": 0.5,
                "description": "éeau éeux ment",
                "keywords": ["éeau", "éeux", "ment"],
            },
        },
    },
    "Role EMPTY": {"title": "Role EMPTY", "description": "", "skills": {}},
}

CURRICULUM = [
    {
        "skill": "Common Words",
        "fundamentals": "frequent words and their order",
        "applied": "counting and comparing frequent words",
        "project": "a frequency table of a large text",
        "topics": ["Word lists", "Frequency", "Stop words"],
    },
    {
        "skill": "Haeufig",
        "fundamentals": "small function words",
        "applied": "sentences built around function words",
        "project": "a grammar sheet with examples",
        "topics": ["Pronouns", "Negation", "Articles"],
    },
    {
        "skill": "Frequents",
        "fundamentals": "prepositions in use",
        "applied": "short texts with prepositions",
        "project": "a glossary of prepositions",
        "topics": ["Pour", "Dans", "Avec"],
    },
]


_TABLES: dict[tuple[str, SparkSession], DataFrame] = {}


def _kept(name: str, spark: SparkSession, table: DataFrame) -> DataFrame:
    """Lookup tables are read by every query of a session, so they are cached in it."""
    return _TABLES.setdefault((name, spark), table.persist())


def profile_text(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(json.dumps(PROFILES, ensure_ascii=False)).alias("value"))


def role_skills(spark: SparkSession) -> DataFrame:
    if ("roles", spark) in _TABLES:
        return _TABLES["roles", spark]
    return _kept("roles", spark, profiles_from_json(profile_text(spark)).coalesce(1))


def curriculum(spark: SparkSession) -> DataFrame:
    if ("curriculum", spark) in _TABLES:
        return _TABLES["curriculum", spark]
    rows = F.from_json(
        F.lit(json.dumps(CURRICULUM, ensure_ascii=False)),
        "array<struct<skill string, fundamentals string, applied string, project string, topics array<string>>>",
    )
    return _kept("curriculum", spark, spark.range(1).select(F.inline(rows)).coalesce(1))
