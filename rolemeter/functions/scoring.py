"""Score arithmetic, levels, tiers and report bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemeter.functions.core import clip, pick, round_exact

# Blend weights, score range, thresholds and their labels.
SEMANTIC_SHARE = 0.55
KEYWORD_SHARE = 0.45
KEYWORD_BOOST = 0.05
SCORE_MIN = 5.0
SCORE_MAX = 98.0
WEAK_BELOW = 50.0
MODEL_FLOOR = 0.20
MODEL_CEILING = 0.65
BENCHMARK = 70.0

LEVELS = [
    (80.0, "Expert / Strong"),
    (65.0, "Proficient"),
    (50.0, "Moderate Competency"),
    (35.0, "Needs Improvement"),
]
LOWEST_LEVEL = "Critical Gap"

TIERS = [
    (80.0, "Interview Ready - High probability of passing technical screen"),
    (60.0, "Nearly Ready - Target core gaps before applying"),
]
LOWEST_TIER = "Foundational Stage - Comprehensive project work required"

BADGES = [(80.0, "green"), (60.0, "amber")]
LOWEST_BADGE = "red"

LEVEL_BANDS = [(80.0, "green"), (65.0, "blue"), (50.0, "amber")]
LOWEST_LEVEL_BAND = "red"

SCREENING = [
    (80.0, "High (Estimated 85%+ pass rate)"),
    (60.0, "Moderate (Pass rate sensitive to specific topic depth)"),
]
LOWEST_SCREENING = "Low without project portfolio reinforcement"

STRATEGIES = [
    (80.0, "Proceed to apply immediately while polishing domain system design questions."),
    (60.0, "Target the top 2 identified gaps for 2-3 weeks before submitting applications."),
]
LOWEST_STRATEGY = "Commit to completing the 4-week project roadmap before formal technical screens."

NO_KEYWORDS_FOUND = "No direct keywords detected"
NO_KEYWORDS_MISSING = "Key frameworks & concepts"
AT_BENCHMARK = "Benchmark Baseline"


def calibrate(similarity: Column, floor: float = MODEL_FLOOR, ceiling: float = MODEL_CEILING) -> Column:
    return clip((similarity - F.lit(floor)) / (F.lit(ceiling) - F.lit(floor)), 0.0, 1.0)


def blend(semantic: Column, ratio: Column, hits: Column) -> Column:
    """Unrounded score: semantic and keyword shares plus a boost for any keyword at all."""
    boost = F.when(hits > 0, F.lit(KEYWORD_BOOST)).otherwise(F.lit(0.0))
    mixed = F.lit(SEMANTIC_SHARE) * semantic + F.lit(KEYWORD_SHARE) * ratio + boost
    return clip(mixed * F.lit(100.0), SCORE_MIN, SCORE_MAX)


def level(score: Column) -> Column:
    return pick(LEVELS, LOWEST_LEVEL, score)


def tier(readiness: Column) -> Column:
    return pick(TIERS, LOWEST_TIER, readiness)


def badge(readiness: Column) -> Column:
    return pick(BADGES, LOWEST_BADGE, readiness)


def level_band(score: Column) -> Column:
    return pick(LEVEL_BANDS, LOWEST_LEVEL_BAND, score)


def screening_probability(readiness: Column) -> Column:
    return pick(SCREENING, LOWEST_SCREENING, readiness)


def strategy(readiness: Column) -> Column:
    return pick(STRATEGIES, LOWEST_STRATEGY, readiness)


def gap(score: Column) -> Column:
    return round_exact(F.lit(100.0) - score, 1)


def benchmark_delta(readiness: Column) -> Column:
    """Signed distance to the fixed benchmark, worded."""
    difference = F.format_string("%.1f%% vs. Benchmark", round_exact(readiness - F.lit(BENCHMARK), 1))
    return F.when(readiness == BENCHMARK, F.lit(AT_BENCHMARK)).otherwise(difference)


def weight_percent(weight: Column) -> Column:
    """Whole percent, truncated."""
    return (weight * F.lit(100)).cast("int")


def matched_display(matched: Column) -> Column:
    return F.when(F.size(matched) > 0, F.array_join(F.slice(matched, 1, 4), ", ")).otherwise(
        F.lit(NO_KEYWORDS_FOUND)
    )


def missing_display(missing: Column) -> Column:
    return F.when(F.size(missing) > 0, F.array_join(F.slice(missing, 1, 3), ", ")).otherwise(
        F.lit(NO_KEYWORDS_MISSING)
    )
