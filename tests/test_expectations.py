"""Labels, thresholds, messages and plan wording as they must read, written out once more by hand."""

import pytest
from pyspark.sql import functions as F

from rolemeter.catalog import fixtures
from rolemeter.functions import scoring
from rolemeter.operators import study_plan
from rolemeter.plans import validation
from rolemeter.sources import files, pages, profiles


@pytest.mark.parametrize(("score", "level", "band"), [
    (98.0, "Expert / Strong", "green"), (80.0, "Expert / Strong", "green"), (79.9, "Proficient", "blue"), (65.0, "Proficient", "blue"),
    (64.9, "Moderate Competency", "amber"), (50.0, "Moderate Competency", "amber"), (49.9, "Needs Improvement", "red"),
    (35.0, "Needs Improvement", "red"), (34.9, "Critical Gap", "red"), (5.0, "Critical Gap", "red"),
])
def test_levels(value, score, level, band):
    assert value(scoring.level(F.lit(score))) == level and value(scoring.level_band(F.lit(score))) == band


@pytest.mark.parametrize(("readiness", "tier", "badge", "chance", "advice"), [
    (80.0, "Interview Ready - High probability of passing technical screen", "green", "High (Estimated 85%+ pass rate)",
     "Proceed to apply immediately while polishing domain system design questions."),
    (79.9, "Nearly Ready - Target core gaps before applying", "amber", "Moderate (Pass rate sensitive to specific topic depth)",
     "Target the top 2 identified gaps for 2-3 weeks before submitting applications."),
    (59.9, "Foundational Stage - Comprehensive project work required", "red", "Low without project portfolio reinforcement",
     "Commit to completing the 4-week project roadmap before formal technical screens."),
])
def test_tiers_and_report_bands(value, readiness, tier, badge, chance, advice):
    column = F.lit(readiness)
    assert value(scoring.tier(column)) == tier and value(scoring.badge(column)) == badge
    assert value(scoring.screening_probability(column)) == chance and value(scoring.strategy(column)) == advice


def test_arithmetic(value):
    both = scoring.blend(scoring.calibrate(F.lit(0.425)), F.lit(0.5), F.lit(2))
    assert value(both) == pytest.approx(100 * (0.55 * 0.5 + 0.45 * 0.5 + 0.05))
    assert value(scoring.blend(F.lit(1.0), F.lit(1.0), F.lit(1))) == 98.0 and value(scoring.blend(F.lit(0.0), F.lit(0.0), F.lit(0))) == 5.0
    assert (value(scoring.calibrate(F.lit(0.20))), value(scoring.calibrate(F.lit(0.65)))) == (0.0, 1.0)
    assert value(scoring.benchmark_delta(F.lit(70.0))) == "Benchmark Baseline"
    assert value(scoring.benchmark_delta(F.lit(62.5))) == "-7.5% vs. Benchmark"


def test_messages():
    assert files.NO_FILE == "No file uploaded. Please upload a valid .pdf or .txt resume."
    assert files.UNSUPPORTED == "Unsupported file format '%s'. Allowed formats: .pdf, .txt"
    assert files.EMPTY_FILE == "The uploaded file is empty (0 bytes)."
    assert files.UNREADABLE_TXT == "Resume Extraction Error: The text file is empty or contains no readable text content."
    assert files.NO_PAGES == "Resume Extraction Error: The PDF document does not contain any pages."
    assert validation.TOO_SHORT == "Resume text is empty or too short for meaningful analysis."
    assert pages.TOO_LITTLE_TEXT == (
        "Could not extract sufficient text from this PDF. The file may be a scanned image without an OCR text layer."
    )
    assert (files.MIN_TXT_CHARS, pages.MIN_PAGED_CHARS, validation.MIN_ANALYSIS_CHARS) == (10, 20, 10)


def test_plan_wording():
    assert [w.title for w in study_plan.GAP_WEEKS][1:] == [
        "Week 2: Applied Tooling & Framework Proficiency — {p} & {s}",
        "Week 3: End-to-End Hands-on Project Implementation — {s} & {t}",
        "Week 4: Productionization, Mock Interviews & Role Readiness — {role}",
    ]
    assert [w.title for w in study_plan.MASTERY_WEEKS] == [
        "Week 1: Advanced Edge Cases & Performance Tuning — {a}",
        "Week 2: Scalable Architecture & System Design for {role}",
        "Week 3: Open-Source Contributions & Capstone Demonstration",
        "Week 4: Executive Technical Screening & Leadership Interview Sprint",
    ]
    assert [len(w.objectives) for w in (*study_plan.GAP_WEEKS, *study_plan.MASTERY_WEEKS)] == [3] * 8


def test_role_names_are_trimmed(value):
    assert value(profiles.requested_role(F.lit(" \t Role EN "))) == "Role EN"


def test_malformed_profiles_are_an_error(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"A": {"skills": {"x": {"weight": ')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        profiles.read_profiles(spark, str(tmp_path / "p.json")).collect()


def test_short_paged_documents_are_refused_everywhere(spark):
    given = spark.createDataFrame([(1, 0, "nineteen characters"), (2, 0, "twenty characters ok"), (3, 0, " ")], "doc_id long, page_no int, page_text string")
    kept = lambda f: sorted({r.doc_id for r in f.select("doc_id").collect()})
    assert kept(pages.assemble(given)) == kept(pages.page_segments(given)) == kept(pages.long_document_lines(given, max_chars=0)) == [2]


def test_an_unknown_role_lists_the_others(spark):
    asked = spark.createDataFrame([(1, "Nobody", "some longer text")], "resume_id long, target_role string, text string")
    refused = validation.resume_rejects(asked, fixtures.role_skills(spark))
    assert refused.first().reason == "Invalid target role 'Nobody'"
    full = validation.with_listing(refused, fixtures.role_skills(spark)).first().reason
    assert full == "Invalid target role 'Nobody'. Available roles are: ['Role EN', 'Role DE', 'Role FR', 'Role EMPTY']"
