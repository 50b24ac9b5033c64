"""Four-week plans: for the ranked gaps of a resume, or a mastery plan when it has none."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.functions.core import built_once
from rolemeter.operators.dimensions import is_small, lookup_join


@dataclass(frozen=True)
class Week:
    title: str
    theme: str
    objectives: tuple[str, str, str]
    project: str
    resources: tuple[str, ...]


# The wording of the plans. Names in braces are filled per resume: {p} {s} {t}
# are the first, second and third gap, {p.field} the learning material of that skill, {gaps}
# the first three gaps, {a} {ab} the heaviest and the two heaviest skills, {role} the role.
GAP_WEEKS = (
    Week(
        "Week 1: Core Fundamentals & Theory — Focus on {p}",
        "Solidifying Core Foundations & Addressing High-Priority Blindspots",
        (
            "Master theoretical concepts: {p.fundamentals}.",
            "Review official documentation and core language/framework idioms for {p}.",
            "Complete 5 foundational exercises to build mechanical fluency.",
        ),
        "Setup dev environment and complete a guided mini-lab covering: {p.fundamentals}.",
        ("Official Documentation", "Interactive Coding Drills"),
    ),
    Week(
        "Week 2: Applied Tooling & Framework Proficiency — {p} & {s}",
        "Practical Execution & Tooling Deep Dive",
        (
            "Bridge theory to practice: {p.applied}.",
            "Deep dive into secondary target skill: {s.fundamentals}.",
            "Implement error handling, logging, and unit verification for all workflows.",
        ),
        "Develop an applied module combining {p} with realistic datasets/scenarios: {p.project}.",
        ("Industry Reference Architectures", "Real-world Dataset Exploration"),
    ),
    Week(
        "Week 3: End-to-End Hands-on Project Implementation — {s} & {t}",
        "Multi-Skill Synthesis & Portfolio Project",
        (
            "Synthesize skills into an integrated solution: {s.project}.",
            "Address edge cases and performance bottlenecks in {t}: {t.applied}.",
            "Document code cleanly with README, architecture overview, and setup instructions.",
        ),
        "Build and push an end-to-end portfolio-grade project resolving real-world requirements for {role}.",
        ("GitHub Open Source Templates", "System Design Cheat Sheets"),
    ),
    Week(
        "Week 4: Productionization, Mock Interviews & Role Readiness — {role}",
        "Interview Simulation, Polish & Screening Preparedness",
        (
            "Conduct 3 timed mock interview sessions covering {gaps}.",
            "Practice articulating architectural tradeoffs, complexity analysis, and debugging scenarios.",
            "Perform final resume audit to clearly highlight projects built during weeks 1-3 for {role} applications.",
        ),
        "Complete a full 60-minute take-home technical assessment simulation and publish code with"
        " Dockerized reproducibility.",
        (
            "{role} Technical Interview Guides",
            "Behavioral STAR Method Articulation",
            "Live Coding & System Design Whiteboarding",
        ),
    ),
)

MASTERY_WEEKS = (
    Week(
        "Week 1: Advanced Edge Cases & Performance Tuning — {a}",
        "From Proficient to Subject Matter Expert",
        (
            "Analyze advanced internals, concurrency, and memory optimization for {a}.",
            "Conduct code reviews and benchmark execution runtimes against large-scale inputs.",
            "Identify non-obvious failure modes in high-concurrency environments.",
        ),
        "Benchmark and refactor an existing {a} codebase for 3x throughput improvement.",
        (
            "Advanced Internals Whitepapers",
            "Profiling & Flamegraph Tools",
            "Production Incident Post-Mortems",
        ),
    ),
    Week(
        "Week 2: Scalable Architecture & System Design for {role}",
        "High-Availability System Design & Tradeoff Analysis",
        (
            "Design resilient end-to-end architectures utilizing {ab}.",
            "Evaluate tradeoffs: latency vs. cost, horizontal vs. vertical scaling, consistency vs. availability.",
            "Draft comprehensive System Architecture Documents (RFC format).",
        ),
        "Author a production RFC and deploy an autoscaling reference pipeline on cloud infrastructure.",
        (
            "Designing Data-Intensive Applications",
            "Enterprise Cloud Reference Architectures",
            "RFC Templates",
        ),
    ),
    Week(
        "Week 3: Open-Source Contributions & Capstone Demonstration",
        "Industry Impact & High-Visibility Portfolio Artifacts",
        (
            "Submit a meaningful PR or bugfix to a prominent open-source library in the ecosystem.",
            "Publish an in-depth technical case study detailing technical challenges and performance metrics.",
            "Refactor all portfolio repositories to production standards (CI/CD, 90%+ test coverage, automated docs).",
        ),
        "Publish a capstone demonstration with live interactive demo and comprehensive documentation.",
        (
            "GitHub Trending Repositories",
            "Technical Blog Publishing",
            "CI/CD Pipeline Automation",
        ),
    ),
    Week(
        "Week 4: Executive Technical Screening & Leadership Interview Sprint",
        "Interview Mastery & Offer Maximization",
        (
            "Practice Senior/Lead level system design interviews with senior mentors.",
            "Structure STAR stories emphasizing high-scale business impact, cross-functional collaboration,"
            " and technical leadership.",
            "Prepare targeted questions for engineering directors regarding infrastructure maturity and roadmaps.",
        ),
        "Record a 5-minute technical presentation explaining a complex architectural decision to technical"
        " stakeholders.",
        (
            "System Design Interview Guides",
            "Engineering Leadership Frameworks",
            "Compensation Negotiation Guides",
        ),
    ),
)

# Learning material of a skill the curriculum does not have, by gap rank.
MISSING_MATERIAL = {
    "p": {
        "fundamentals": "Core concepts and principles of {skill}",
        "applied": "Hands-on exercises and standard tooling for {skill}",
        "project": "Build a focused working demonstration utilizing {skill}",
        "topics": ("{skill} essentials", "Best practices", "Hands-on implementation"),
    },
    "s": {
        "fundamentals": "Core theory and syntax for {skill}",
        "applied": "Practical workflows and problem-solving with {skill}",
        "project": "Implement a standalone mini-project in {skill}",
        "topics": ("{skill} fundamentals", "Applied drills", "Integration"),
    },
    "t": {
        "fundamentals": "Core knowledge and workflows for {skill}",
        "applied": "Intermediate techniques and design for {skill}",
        "project": "Real-world application of {skill}",
        "topics": ("{skill} theory", "Optimization", "Testing"),
    },
}
LEADERSHIP_FOCUS = "{role} Leadership"

FIELDS = ("fundamentals", "applied", "project")
_SLOT = re.compile(r"\{([a-z.]+)\}")


def fill(template: str, slots: dict[str, Column]) -> Column:
    """A template as one concatenation of its fixed parts and slot columns."""
    parts = [
        slots[piece] if i % 2 else F.lit(piece)
        for i, piece in enumerate(_SLOT.split(template))
        if i % 2 or piece
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _texts(templates: tuple[str, ...], slots: dict[str, Column]) -> Column:
    return F.array(*[fill(t, slots) for t in templates])


def _week(number: int, week: Week, slots: dict[str, Column], focus: Column, material: Column | None = None) -> Column:
    resources = _texts(week.resources, slots)
    return F.struct(
        F.lit(number).alias("week"),
        fill(week.title, slots).alias("title"),
        focus.alias("focus_skills"),
        F.lit(week.theme).alias("theme"),
        _texts(week.objectives, slots).alias("weekly_objectives"),
        fill(week.project, slots).alias("hands_on_project"),
        (resources if material is None else F.concat(material, resources)).alias("key_resources"),
    )


def focus_of_gaps(gap_names: Column) -> dict[str, Column]:
    """First, second and third gap; a missing one repeats the one before."""
    first = F.get(gap_names, F.lit(0))
    second = F.coalesce(F.get(gap_names, F.lit(1)), first)
    return {"p": first, "s": second, "t": F.coalesce(F.get(gap_names, F.lit(2)), second)}


def week_focus(p: Column, s: Column, t: Column) -> tuple[Column, Column, Column]:
    """Focus lists of weeks 1 to 3. Repeated skills count once; week 3 keeps the first two."""
    return (
        F.array(p),
        F.array_distinct(F.array(p, s)),
        F.slice(F.array_distinct(F.array(p, s, t)), 1, 2),
    )


def gap_plan(ranks: dict[str, Column], material: dict[str, Column], gap_names: Column, role: Column) -> Column:
    slots = {**ranks, "role": role, "gaps": F.array_join(gap_names, ", ")}
    topics = {}
    for rank, skill in ranks.items():
        row, default = material[rank], MISSING_MATERIAL[rank]
        for field in FIELDS:
            slots[f"{rank}.{field}"] = F.coalesce(row[field], fill(default[field], {"skill": skill}))
        topics[rank] = F.coalesce(row["topics"], _texts(default["topics"], {"skill": skill}))
    first, second, third = week_focus(ranks["p"], ranks["s"], ranks["t"])
    return F.array(
        _week(1, GAP_WEEKS[0], slots, first, topics["p"]),
        _week(2, GAP_WEEKS[1], slots, second, topics["s"]),
        _week(3, GAP_WEEKS[2], slots, third, topics["t"]),
        _week(4, GAP_WEEKS[3], slots, gap_names),
    )


def mastery_plan(top_names: Column, role: Column) -> Column:
    first, first_two = F.get(top_names, F.lit(0)), F.slice(top_names, 1, 2)
    slots = {"a": first, "ab": F.array_join(first_two, ", "), "role": role}
    focus = (F.array(first), first_two, top_names, F.array(fill(LEADERSHIP_FOCUS, slots)))
    return F.array(*[_week(i + 1, MASTERY_WEEKS[i], slots, focus[i]) for i in range(4)])


@built_once
def plan_column() -> Column:
    """The plan of a row: by gaps if there are any, else by weight, empty without skills."""
    by_gap = gap_plan(
        {rank: F.col(f"_{rank}") for rank in "pst"},
        {rank: F.col(f"_{rank}_material") for rank in "pst"},
        F.col("gap_names"), F.col("target_role"),
    )
    by_weight = mastery_plan(F.col("top_names"), F.col("target_role"))
    none = F.filter(by_weight, lambda w: F.lit(False))
    return F.when(F.size("gap_names") > 0, by_gap).when(F.size("top_names") > 0, by_weight).otherwise(none)


def with_study_plan(ranked: DataFrame, curriculum: DataFrame) -> DataFrame:
    """Add `study_plan` to rows with `target_role, gap_names, top_names`.

    `gap_names` and `top_names` hold the first three gaps and the three heaviest skills. A
    resume without any skill gets an empty plan.
    """
    ranks = focus_of_gaps(F.col("gap_names"))
    rows = ranked.withColumns({f"_{rank}": skill for rank, skill in ranks.items()})
    small = is_small(curriculum)
    for rank in ranks:
        material = curriculum.select(
            F.col("skill").alias(f"_{rank}"), F.struct(*FIELDS, "topics").alias(f"_{rank}_material")
        )
        rows = lookup_join(rows, material, f"_{rank}", "left", small)
    plan = plan_column()
    helpers = [f"_{rank}" for rank in ranks] + [f"_{rank}_material" for rank in ranks]
    return rows.withColumn("study_plan", plan).drop(*helpers)


def plan_rows(planned: DataFrame) -> DataFrame:
    """One row per resume and week."""
    return planned.select("resume_id", F.col("target_role").alias("role"), F.inline("study_plan"))
