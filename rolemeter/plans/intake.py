"""From uploaded files to resumes, with every file accounted for."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemeter.operators.identity import DOC_KEY
from rolemeter.operators.layout import stored_counted
from rolemeter.operators.skills import Semantic
from rolemeter.plans.analysis import analyse, analyse_large, readiness_of
from rolemeter.plans.validation import known_roles, resume_rejects
from rolemeter.sources import files as file_source
from rolemeter.sources import pages as page_source
from rolemeter.sources.profiles import requested_role


class LostFiles(RuntimeError):
    """The steps of an intake do not account for as many files as came in."""


class Intake(NamedTuple):
    """What becomes of every file.

    `resumes` (`doc_key, resume_id, target_role, text`) can be analysed; `long_segments`, the lines of
    documents too long for one value, through `analyse_large`. `long_resumes` names the latter,
    `doc_key, resume_id, target_role`. `rejects` has `resume_id, target_role, stage, reason` of every other
    file, and also of resumes of a role without skills, which are scored but get no plan.
    `counts` says how many files went which way, up to the checks of the role.
    """

    resumes: DataFrame
    long_segments: DataFrame
    long_resumes: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def intake(
    files: DataFrame, role_skills: DataFrame, extract: Callable[[bytes], Iterable[file_source.Page]] | None = None
) -> Intake:
    """Check, decode and normalise files with `path, filename, content, target_role`.

    The path is the resume id, but a row is a file of its own, whatever its path: one given twice is answered
    twice, and one without a path is answered too. Contents are read in one pass, which stores
    each file's outcome: the reason it is refused, the text of a TXT file, or what is left to read of
    a PDF file. The pages of the latter, read by `extract`, are stored too and then treated as any
    paged document. A text of any kind that is longer than `pages.MAX_ASSEMBLED_CHARS` is scored from its lines.
    Files are counted as they are written at every step; if a step has lost one, `LostFiles` is raised.
    """
    asked = files.withColumn("target_role", requested_role(F.col("target_role")))
    refusal, is_pdf = F.col("reason").isNotNull(), F.col("pdf").isNotNull()
    seen, counts = stored_counted(
        file_source.classified(asked).withColumn(DOC_KEY, F.monotonically_increasing_id()), "files",
        files=F.count(F.lit(1)), refused=F.count_if(refusal), pdf=F.count_if(~refusal & is_pdf), txt=F.count_if(~refusal & ~is_pdf & F.col("text").isNotNull()),
    )
    _balanced(counts["files"], counts["refused"] + counts["pdf"] + counts["txt"], "checked")
    names = [DOC_KEY, F.col("path").alias("resume_id"), "target_role"]
    refused = seen.where(refusal).select(*names, "stage", "reason")
    roles = seen.select(F.col(DOC_KEY).alias("doc_id"), F.col("path").alias("resume_id"), "target_role")

    bound = F.lit(page_source.MAX_ASSEMBLED_CHARS)
    txt = seen.where(F.col("text").isNotNull() & F.col("reason").isNull())
    short_txt = txt.where(F.length("text") <= bound).select(*names, "text")
    long_txt = txt.where(F.length("text") > bound).select(
        F.col(DOC_KEY).alias("doc_id"), F.lit(0).alias("page_no"), F.col("text").alias("page_text")
    )

    pdf = seen.where(is_pdf).select(F.col(DOC_KEY).alias("doc_id"), F.col("pdf").alias("content"))
    pages, read = stored_counted(
        file_source.read_pages(pdf, extract, "doc_id"), "pdf-pages", read=F.count_if(F.col("page_no") == 0), unreadable=F.count_if(refusal),
    )
    _balanced(counts["pdf"], read["read"], "read")
    readable = pages.where(F.col("reason").isNull()).drop("reason")
    sizes, sized = stored_counted(
        page_source.document_sizes(readable), "pdf-sizes", sized=F.count(F.lit(1)), too_little=F.count_if(refusal),
    )
    _balanced(read["read"] - read["unreadable"], sized["sized"], "put together")
    broken = pages.where(refusal).select("doc_id", "reason").unionByName(sizes.where(refusal).select("doc_id", "reason"))

    def named(rows: DataFrame, *columns) -> DataFrame:
        return rows.join(roles, "doc_id").select(F.col("doc_id").alias(DOC_KEY), "resume_id", "target_role", *columns)

    unreadable = named(broken, F.lit("parse").alias("stage"), "reason")
    short_pdf = named(page_source.assemble(readable, sizes), "text")
    lines = page_source.page_lines(long_txt).unionByName(page_source.long_document_lines(readable, sizes))
    long_segments = named(lines, page_source.line_order().alias("segment_no"), "gap", F.col("line").alias("text"))
    long_ids = long_txt.select("doc_id").unionByName(
        sizes.where(F.col("reason").isNull() & (F.col("n_chars") > bound)).select("doc_id")
    )
    long_resumes = named(long_ids)

    resumes = short_txt.unionByName(short_pdf)
    # A long document is long enough by definition; only its role remains to be checked.
    checked = resumes.unionByName(long_resumes.withColumn("text", F.lit(page_source.TOO_LITTLE_TEXT)))
    rejects = refused.unionByName(unreadable).unionByName(resume_rejects(checked, role_skills)).drop(DOC_KEY)
    gone = counts["refused"] + read["unreadable"] + sized["too_little"]
    return Intake(resumes, long_segments, long_resumes, rejects, counts | read | sized | {"rejected": gone, "accepted": counts["files"] - gone})


def _balanced(came: int, went: int, step: str) -> None:
    if came != went:
        raise LostFiles(f"{came} files came in, {went} were {step}")


def readiness_of_files(found: Intake, role_skills: DataFrame, semantic: Semantic = Semantic()) -> DataFrame:
    """Readiness of every accepted file, short or long: the columns of `readiness_of`.

    The long form is planned only where there is a long document.
    """
    short = analyse(found.resumes.drop(DOC_KEY), role_skills, semantic).select(
        "resume_id", F.col("target_role").alias("role"), "readiness_score", "readiness_tier", "n_skills", "n_gaps"
    )
    if found.long_resumes.isEmpty():
        return short
    scores = analyse_large(found.long_segments, role_skills, semantic)
    return short.unionByName(readiness_of(scores, known_roles(found.long_resumes, role_skills)))
