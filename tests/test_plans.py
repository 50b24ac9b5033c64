"""Gaps, study plans, validation and reports on a few resumes."""

from pyspark.sql import functions as F

from rolemeter import schemas
from rolemeter.operators import gaps, report
from rolemeter.operators.skills import Semantic, skill_rows
from rolemeter.operators.study_plan import plan_rows, with_study_plan
from rolemeter.plans.analysis import analyse, with_plan
from rolemeter.plans.validation import long_enough, resume_rejects, with_listing

KEYWORDS_ONLY = Semantic("none")


def role(spark, *skills):
    rows = [("R", 0, name, i, weight, "", words) for i, (name, weight, words) in enumerate(skills)]
    return spark.createDataFrame(rows + [("Empty", 1, None, None, 0.1, "", [])], schemas.ROLE_SKILLS)


def resumes(spark, *texts):
    return spark.createDataFrame([(i, "R", t) for i, t in enumerate(texts)], schemas.RESUMES)


def curriculum(spark, *skills):
    return spark.createDataFrame(
        [(s, f"{s} basics", f"{s} practice", f"{s} build", [f"{s}1", f"{s}2", f"{s}3"]) for s in skills], schemas.CURRICULUM
    )


def focus(spark, gap_names, top_names):
    return spark.createDataFrame(
        [(1, "R", gap_names, top_names)],
        "resume_id bigint, target_role string, gap_names array<string>, top_names array<string>",
    )


def plan(spark, gap_names, top_names=("A",), known=()):
    rows = plan_rows(with_study_plan(focus(spark, list(gap_names), list(top_names)), curriculum(spark, *known)))
    return rows.orderBy("week").collect()


def test_gap_order_is_weight_then_score_then_profile(spark):
    skills = role(
        spark, ("a", 0.2, ["x1", "x2"]), ("b", 0.5, ["x3"]), ("c", 0.2, ["x4", "hit", "x5", "x6"]), ("d", 0.2, ["x7"]),
        ("e", 0.1, ["hit"]),
    )
    analysed = analyse(resumes(spark, "a hit in the text"), skills, KEYWORDS_ONLY)
    ranked = gaps.gap_rows(analysed).orderBy("priority").collect()
    assert [(r.skill, r.score) for r in ranked] == [("b", 5.0), ("a", 5.0), ("d", 5.0), ("c", 16.2)]
    assert ranked[0].gap == 95.0 and ranked[3].missing_keywords == ["x4", "x5", "x6"]
    row = analysed.first()
    assert (row.n_skills, row.n_gaps) == (5, 4)
    assert row.readiness_score == round((5 * 0.2 + 5 * 0.5 + 16.2 * 0.2 + 5 * 0.2 + 50.0 * 0.1) / (0.2 + 0.5 + 0.2 + 0.2 + 0.1), 1)


def test_five_missing_keywords_are_kept(spark):
    skills = role(spark, ("a", 0.2, list("bcdefgh")))
    assert gaps.gap_rows(analyse(resumes(spark, "nothing here at all"), skills, KEYWORDS_ONLY)).first().missing_keywords == list("bcdef")


def test_total_weight_of_zero_counts_as_one(spark):
    skills = role(spark, ("a", 0.0, ["hit"]), ("b", -1.0, ["hit"]))
    assert analyse(resumes(spark, "one hit is here"), skills, KEYWORDS_ONLY).first().readiness_score == 0.0


def test_three_gaps(spark):
    weeks = plan(spark, ["A", "B", "C"], known=("A", "B", "C"))
    assert [w.week for w in weeks] == [1, 2, 3, 4]
    assert [w.focus_skills for w in weeks] == [["A"], ["A", "B"], ["A", "B"], ["A", "B", "C"]]
    assert weeks[0].weekly_objectives[0] == "Master theoretical concepts: A basics."
    assert weeks[1].hands_on_project.endswith("combining A with realistic datasets/scenarios: A build.")
    assert weeks[1].key_resources == ["B1", "B2", "B3", "Industry Reference Architectures", "Real-world Dataset Exploration"]
    assert weeks[2].title.endswith("— B & C")
    assert weeks[3].weekly_objectives[0].endswith("covering A, B, C.")


def test_missing_material_depends_on_rank(spark):
    weeks = plan(spark, ["A", "B", "C"])
    assert weeks[0].key_resources[:3] == ["A essentials", "Best practices", "Hands-on implementation"]
    assert weeks[1].key_resources[:3] == ["B fundamentals", "Applied drills", "Integration"]
    assert weeks[2].key_resources[:3] == ["C theory", "Optimization", "Testing"]
    assert "Core theory and syntax for B" in weeks[1].weekly_objectives[1]


def test_one_and_two_gaps_repeat_the_last(spark):
    one = plan(spark, ["A"], known=("A",))
    assert [w.focus_skills for w in one] == [["A"], ["A"], ["A"], ["A"]]
    assert one[1].title.endswith("— A & A")
    two = plan(spark, ["A", "B"])
    assert [w.focus_skills for w in two] == [["A"], ["A", "B"], ["A", "B"], ["A", "B"]]
    assert two[2].title.endswith("— B & B")


def test_no_gap_gives_the_mastery_plan_and_no_skill_none(spark):
    weeks = plan(spark, [], ["A", "B", "C"])
    assert [w.focus_skills for w in weeks] == [["A"], ["A", "B"], ["A", "B", "C"], ["R Leadership"]]
    assert "utilizing A, B." in weeks[1].weekly_objectives[0]
    assert plan(spark, [], []) == []


def test_rejects_and_accepted_are_the_input(spark):
    skills = role(spark, ("a", 0.2, ["x"]))
    rows = [(1, "R", "long enough text"), (2, "R", " short   "), (3, "Nobody", "long enough text"), (4, "Empty", "long enough text"), (5, None, None)]
    asked = spark.createDataFrame(rows, schemas.RESUMES)
    rejects = {r.resume_id: (r.stage, r.reason) for r in with_listing(resume_rejects(asked, skills), skills).collect()}
    assert {k: v[0] for k, v in rejects.items()} == {2: "analyse", 3: "role", 4: "plan", 5: "analyse"}
    assert rejects[3][1] == "Invalid target role 'Nobody'. Available roles are: ['R', 'Empty']"
    analysed = analyse(asked.where(long_enough(F.col("text"))), skills, KEYWORDS_ONLY)
    assert {r.resume_id: (r.readiness_score, r.n_skills) for r in analysed.collect()} == {1: (5.0, 1), 4: (0.0, 0)}


def test_reports(spark):
    skills = role(spark, ("a", 0.29, ["x"]), ("b", 0.5, ["hit"]), ("c", 0.5, ["hit"]))
    analysed = analyse(resumes(spark, "one hit is here"), skills, KEYWORDS_ONLY)
    row = report.report(analysed).first()
    assert (row.strongest_skill, row.strongest_score, row.badge, row.n_gaps) == ("b", 50.0, "red", 1)
    ranking = report.skill_report(analysed).orderBy("place").collect()
    assert [(r.skill, r.weight_percent, r.matched_shown) for r in ranking] == [
        ("b", 50, "hit"), ("c", 50, "hit"), ("a", 28, "No direct keywords detected"),
    ]
    assert report.gap_report(gaps.gap_rows(analysed)).first().review == "x"


def test_response_has_five_fields_in_profile_order(spark):
    import json

    skills = role(spark, ("b", 0.2, ["x"]), ("a", 0.5, ["hit"]))
    planned = with_plan(analyse(resumes(spark, "one hit is here"), skills, KEYWORDS_ONLY), curriculum(spark))
    body = json.loads(report.response_json(planned).first().json)
    assert list(body) == ["readiness_score", "skill_breakdown", "missing_skills", "readiness_tier", "study_plan"]
    assert list(body["skill_breakdown"]) == ["b", "a"]
    assert list(body["skill_breakdown"]["a"]) == [
        "score", "weight", "level", "matched_keywords", "missing_keywords", "semantic_similarity",
    ]
    assert len(body["study_plan"]) == 4 and body["missing_skills"][0]["skill"] == "b"


def test_a_matched_keyword_never_lowers_a_score(spark):
    words = [f"word{i}" for i in range(6)]
    texts = [" ".join(["some filler text here"] + words[:n]) for n in range(7)]
    scored = skill_rows(analyse(resumes(spark, *texts), role(spark, ("a", 0.2, words)), KEYWORDS_ONLY))
    scores = [r.score for r in scored.orderBy("resume_id").collect()]
    assert scores == sorted(scores) and scores[0] == 5.0 and scores[-1] == 50.0
