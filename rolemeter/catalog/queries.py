"""The registered queries. Each reads whole tables of `sf_dir`."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemeter.catalog import fixtures
from rolemeter.functions.core import round_exact
from rolemeter.functions.keywords import keyword_ratio
from rolemeter.functions.text import normalize, sentences
from rolemeter.functions.vectors import sparse_vector
from rolemeter.operators import embeddings, gaps, long_form, report, study_plan
from rolemeter.operators.dimensions import lookup_join
from rolemeter.operators.identity import identified
from rolemeter.operators.layout import computed_once, spread, stored
from rolemeter.operators.skills import Semantic, skill_rows, with_vectors
from rolemeter.plans.analysis import analyse, analyse_large, analyse_with_model, gaps_of, plan_of, readiness_of, with_focus, with_plan
from rolemeter.plans.intake import intake, readiness_of_files
from rolemeter.plans.validation import known_roles, long_enough, resume_rejects, with_listing
from rolemeter.schemas import VECTORS
from rolemeter.session import scratch_dir
from rolemeter.sources import files as file_source
from rolemeter.sources import pages as page_source
from rolemeter.sources.profiles import query_text, role_listing, role_payloads
from rolemeter.streaming.readiness import run_stream, score_stream, write_stream

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(name: str):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = query
        return query

    return add


def long(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")


def listed(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def target_role() -> Column:
    """Documents ask for a role by language; one language asks for an empty and an unknown role."""
    return (
        F.when(F.col("lang") == "en", "Role EN")
        .when(F.col("lang") == "de", "Role DE")
        .when(F.col("lang") == "fr", "Role FR")
        .when(F.col("doc_id") % 2 == 0, "Role EMPTY")
        .otherwise("Role Unknown")
    )


def normalised(documents: DataFrame) -> DataFrame:
    raw = documents.select(F.col("doc_id").alias("resume_id"), target_role().alias("target_role"), "text")
    return computed_once(raw, "text", normalize(F.col("text")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as resumes, normalised."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return normalised(spread(documents, "doc_id"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents long enough to be analysed."""
    return texts(spark, sf_dir).where(long_enough(F.col("text")))


def analysed(spark: SparkSession, sf_dir: str, semantic: Semantic = fixtures.SEMANTIC) -> DataFrame:
    return analyse(resumes(spark, sf_dir), fixtures.role_skills(spark), semantic)


@registered("q_normalize")
def normalize_text(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "resume_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), long(F.length("text")).alias("n_chars")
    )


@registered("q_sentences")
def sentence_rows(spark, sf_dir):
    return (
        resumes(spark, sf_dir)
        .select("resume_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
        .select("resume_id", long("pos").alias("sentence_no"), "sentence")
    )


@registered("q_chunks")
def chunks(spark, sf_dir):
    return embeddings.chunk_rows(resumes(spark, sf_dir)).select("resume_id", long("chunk_no").alias("chunk_no"), "chunk")


@registered("q_keyword_hits")
def keyword_hits(spark, sf_dir):
    return skill_rows(analysed(spark, sf_dir, Semantic("none"))).select(
        "resume_id", "skill", listed("matched_keywords"), listed("missing_keywords"),
        long(F.size("matched_keywords")).alias("n_matched"),
    )


@registered("q_keyword_ratio")
def keyword_ratios(spark, sf_dir):
    rows = skill_rows(analysed(spark, sf_dir, Semantic("none")))
    hits, total = F.size("matched_keywords"), F.size("matched_keywords") + F.size("missing_keywords")
    return rows.select("resume_id", "skill", keyword_ratio(hits, total).alias("ratio"))


@registered("q_keyword_readiness")
def keyword_readiness(spark, sf_dir):
    return analysed(spark, sf_dir, Semantic("none")).select(
        "resume_id", F.col("target_role").alias("role"), "readiness_score", "readiness_tier"
    )


@registered("q_query_text")
def query_texts(spark, sf_dir):
    """What every skill is embedded as, with how many resumes ask for its role."""
    asked = resumes(spark, sf_dir).groupBy(F.col("target_role").alias("role")).agg(F.count(F.lit(1)).alias("n_resumes"))
    skills = query_text(fixtures.role_skills(spark).where(F.col("skill").isNotNull()))
    counted = lookup_join(skills.select("role", "skill", "query_text"), asked, "role", "left", spread_by="skill")
    return counted.select("role", "skill", "query_text", F.coalesce("n_resumes", F.lit(0)).cast("bigint").alias("n_resumes"))


@registered("q_roles")
def roles(spark, sf_dir):
    """Role listing with how many documents ask for each role."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    asked = documents.groupBy(target_role().alias("role")).agg(F.count(F.lit(1)).alias("n_resumes"))
    listing = role_listing(fixtures.role_skills(spark)).join(role_payloads(fixtures.profile_text(spark)), "role")
    return listing.join(asked, "role", "left").select(
        "role", long("role_ord").alias("role_ord"), long("n_skills").alias("n_skills"),
        long("n_keywords").alias("n_keywords"), F.coalesce("n_resumes", F.lit(0)).cast("bigint").alias("n_resumes"),
        "title", "profile",
    )


def labelled_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors grouped by label as the chunks of documents, and one query vector per label.

    The query of a label is its first vector. Even and odd labels are two roles, and a document
    is compared to the queries of its role.
    """
    vectors = spark.read.schema(VECTORS).parquet(f"{sf_dir}/embeddings.parquet")
    role = F.when(F.col("label") % 2 == 0, "even").otherwise("odd")
    chunk_vectors = vectors.select(
        long("label").alias("resume_id"), role.alias("target_role"), F.col("vec_id").alias("chunk_no"), "embedding"
    )
    queries = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        role.alias("role"), F.col("label").cast("string").alias("skill"), "embedding"
    )
    return chunk_vectors, stored(queries, "label-queries")


@registered("q_dense_similarity")
def dense_similarity(spark, sf_dir):
    """Closest query of every vector."""
    best = embeddings.closest(*labelled_vectors(spark, sf_dir))
    return best.select(F.col("chunk_no").alias("vec_id"), "skill", "similarity")


@registered("q_dense_top2")
def dense_top2(spark, sf_dir):
    best = embeddings.best_chunks(embeddings.chunk_similarities(*labelled_vectors(spark, sf_dir)))
    return best.select(
        long("resume_id").alias("label"), "skill", round_exact(F.col("similarity"), 3).alias("semantic_similarity")
    )


@registered("q_hashed_vectors")
def hashed_vectors(spark, sf_dir):
    vector = sparse_vector(F.col("chunk"), fixtures.SEMANTIC.dim)
    return (
        embeddings.chunk_rows(resumes(spark, sf_dir))
        .select("resume_id", "chunk_no", vector.alias("v"))
        .select(
            "resume_id", long("chunk_no").alias("chunk_no"),
            F.array_join(F.transform("v.buckets", lambda b: b.cast("string")), ",").alias("buckets"),
            round_exact(F.col("v.norm"), 3).alias("norm"),
        )
    )


@registered("q_skill_scores")
def skill_scores(spark, sf_dir):
    return score_table(skill_rows(analysed(spark, sf_dir)))


@registered("q_levels")
def levels(spark, sf_dir):
    return skill_rows(analysed(spark, sf_dir)).groupBy("role", "level").agg(F.count(F.lit(1)).alias("n"))


READINESS = ["resume_id", "target_role as role", "readiness_score", "readiness_tier", "n_skills", "n_gaps"]


@registered("q_readiness")
def readiness(spark, sf_dir):
    return analysed(spark, sf_dir).selectExpr(*READINESS)


@registered("q_gaps")
def skill_gaps(spark, sf_dir):
    return gaps.gap_rows(analysed(spark, sf_dir)).select(
        "resume_id", "role", long("priority").alias("priority"), "skill", "score", "weight", "gap", "level",
        listed("matched_keywords"), listed("missing_keywords"),
    )


@registered("q_gap_focus")
def gap_focus(spark, sf_dir):
    focused = with_focus(analysed(spark, sf_dir)).where(F.col("n_gaps") > 0)
    ranks = focused.select("resume_id", *[c.alias(n) for n, c in study_plan.focus_of_gaps(F.col("gap_names")).items()])
    _, second, third = study_plan.week_focus(F.col("p"), F.col("s"), F.col("t"))
    return ranks.select(
        "resume_id", F.col("p").alias("first_gap"), F.col("s").alias("second_gap"), F.col("t").alias("third_gap"),
        F.array_join(second, "|").alias("week2_focus"), F.array_join(third, "|").alias("week3_focus"),
    )


def plan_table(planned: DataFrame) -> DataFrame:
    return study_plan.plan_rows(planned).select(
        "resume_id", "role", long("week").alias("week"), "title", listed("focus_skills"), "theme",
        listed("weekly_objectives"), "hands_on_project", listed("key_resources"),
    )


@registered("q_gap_plan")
def gap_plan(spark, sf_dir):
    planned = with_plan(analysed(spark, sf_dir), fixtures.curriculum(spark))
    return plan_table(planned.where(F.size("gap_names") > 0))


@registered("q_mastery_plan")
def mastery_plan(spark, sf_dir):
    planned = with_plan(analysed(spark, sf_dir), fixtures.curriculum(spark))
    return plan_table(planned.where(F.size("gap_names") == 0))


@registered("q_study_plan")
def study_plans(spark, sf_dir):
    return plan_table(with_plan(analysed(spark, sf_dir), fixtures.curriculum(spark)))


@registered("q_strongest_skill")
def skill_ranking(spark, sf_dir):
    return report.skill_report(analysed(spark, sf_dir)).select(
        "resume_id", "role", long("place").alias("place"), "skill", "score", "level", "level_band",
        long("weight_percent").alias("weight_percent"), "matched_shown",
    )


@registered("q_gap_review")
def gap_review(spark, sf_dir):
    return report.gap_report(gaps.gap_rows(analysed(spark, sf_dir))).select(
        "resume_id", "role", long("priority").alias("priority"), "skill", "score", "gap",
        long("weight_percent").alias("weight_percent"), "review",
    )


@registered("q_report")
def candidate_report(spark, sf_dir):
    return report.report(analysed(spark, sf_dir))


@registered("q_result_json")
def result_json(spark, sf_dir):
    return report.response_json(with_plan(analysed(spark, sf_dir), fixtures.curriculum(spark)))


@registered("q_rejects")
def rejects(spark, sf_dir):
    role_skills = fixtures.role_skills(spark)
    refused = resume_rejects(texts(spark, sf_dir), role_skills)
    return with_listing(refused, role_skills).select("resume_id", "stage", "reason")


# Endings of uploads with a fault of their own, by what is left of the document number divided by 20.
FAULTS = {4: "_blank.txt", 5: "_tiny.txt", 12: "_empty.pdf", 13: "_locked.pdf", 14: "_broken.pdf", 15: "_scan.pdf"}


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an uploaded file, with its whole text, and further files with faults.

    By document the name is one that is refused, or the file is a PDF (in this catalog: a page a
    line, see `line_reader`), or the text is Latin-1 where that can hold it.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    kind = F.col("doc_id") % 20
    stem = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    latin = F.col("text").rlike(r"\A[\x00-\xff]*\z") & kind.isin(6, 7, 8)
    name = (
        F.when(kind == 1, F.concat(stem, F.lit(".docx"))).when(kind == 2, F.lit(None)).when(kind == 3, F.concat(stem, F.lit(".TXT")))
        .when(kind.isin(9, 10, 11), F.concat(stem, F.lit(".pdf"))).otherwise(F.concat(stem, F.lit(".txt")))
    )
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.col("text").cast("binary"))
    file = lambda filename, data: F.struct(filename.alias("filename"), data.alias("content"))
    own = F.array(file(name, content))
    faulty = F.lit(None).cast("array<struct<filename:string,content:binary>>")
    for remainder, ending in FAULTS.items():
        data = F.lit(" \n\t\n") if ending == "_blank.txt" else F.col("source") if ending == "_tiny.txt" else F.lit(ending)
        faulty = F.when(kind == remainder, F.array(file(F.concat(stem, F.lit(ending)), data.cast("binary")))).otherwise(faulty)
    files = F.concat(own, F.coalesce(faulty, F.array().cast("array<struct<filename:string,content:binary>>")))
    return spread(documents, "doc_id").select("doc_id", target_role().alias("target_role"), F.explode(files).alias("file")).select(
        "doc_id", "target_role", F.concat_ws("/", F.col("doc_id").cast("string"), "file.filename").alias("path"), "file.filename", "file.content"
    )


def line_reader() -> Callable[[bytes], list[str]]:
    """A stand-in for a PDF reader: every line is a page. Made here, so it reaches tasks by value."""
    from rolemeter.sources.files import CorruptFile, EncryptedFile

    def read(content: bytes) -> list[str]:
        text = content.decode()
        if text == "_locked.pdf":
            raise EncryptedFile
        if text == "_broken.pdf":
            raise CorruptFile("no header")
        return [] if text == "_empty.pdf" else text.split("\n")

    return read


@registered("q_files")
def uploaded_texts(spark, sf_dir):
    return file_source.txt_documents(uploads(spark, sf_dir)).select(
        "doc_id", "filename", F.md5(F.col("text").cast("binary")).alias("text_md5"), long(F.length("text")).alias("n_chars")
    )


@registered("q_file_rejects")
def upload_rejects(spark, sf_dir):
    return file_source.file_rejects(uploads(spark, sf_dir)).select("doc_id", "filename", "stage", "reason")


@registered("q_intake_readiness")
def intake_readiness(spark, sf_dir):
    """From uploaded files to readiness."""
    role_skills = fixtures.role_skills(spark)
    found = intake(uploads(spark, sf_dir), role_skills, line_reader())
    return readiness_of_files(found, role_skills, fixtures.SEMANTIC).withColumnRenamed("resume_id", "path")


@registered("q_intake_rejects")
def intake_rejects(spark, sf_dir):
    """Every file that was refused at some step, with the step and the reason."""
    role_skills = fixtures.role_skills(spark)
    found = intake(uploads(spark, sf_dir), role_skills, line_reader())
    return with_listing(found.rejects, role_skills).select(F.col("resume_id").alias("path"), "stage", "reason")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged documents, every turn a page."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), F.col("text").alias("page_text"))


@registered("q_pages")
def pages(spark, sf_dir):
    return page_source.page_lines(paged(spark, sf_dir))


@registered("q_paged_documents")
def paged_documents(spark, sf_dir):
    return page_source.document_sizes(paged(spark, sf_dir)).select(
        "doc_id", "n_pages", "n_lines", "n_chars", F.coalesce("reason", F.lit("")).alias("reason")
    )


def role_by_number(number: str = "doc_id") -> Column:
    names = F.array(*[F.lit(name) for name in ("Role EN", "Role DE", "Role FR")])
    return F.get(names, (F.col(number) % 3).cast("int"))


def paged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as segments of the accepted documents, which ask for a role by their number."""
    return page_source.page_segments(paged(spark, sf_dir)).select(
        F.col("doc_id").alias("resume_id"), role_by_number().alias("target_role"), "segment_no", "gap", "text"
    )


@registered("q_paged_texts")
def paged_texts(spark, sf_dir):
    """Accepted paged documents put together."""
    return page_source.assemble(paged(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@registered("q_paged_chunks")
def paged_chunks(spark, sf_dir):
    """Chunks of paged documents, cut across pages without putting a document together."""
    return long_form.chunk_rows(long_form.prepared(paged_segments(spark, sf_dir))).select("resume_id", "chunk_no", "chunk")


@registered("q_paged_scores")
def paged_scores(spark, sf_dir):
    scores = analyse_large(paged_segments(spark, sf_dir), fixtures.role_skills(spark), fixtures.SEMANTIC)
    return score_table(scores)


@registered("q_paged_readiness")
def paged_readiness(spark, sf_dir):
    """Paged documents put together where they are short enough, scored from pages where not."""
    pages_ = paged(spark, sf_dir)
    sizes = stored(page_source.document_sizes(pages_), "page-sizes")
    asked = [F.col("doc_id").alias("resume_id"), role_by_number().alias("target_role")]
    whole = analyse(page_source.assemble(pages_, sizes).select(*asked, "text"), fixtures.role_skills(spark), fixtures.SEMANTIC)
    short = whole.selectExpr(*READINESS)
    if not page_source.any_long(sizes):
        return short
    lines = page_source.long_document_lines(pages_, sizes).select(
        *asked, page_source.line_order().alias("segment_no"), "gap", F.col("line").alias("text")
    )
    scores = analyse_large(lines, fixtures.role_skills(spark), fixtures.SEMANTIC)
    return short.unionByName(readiness_of(scores, lines))


def score_table(rows: DataFrame) -> DataFrame:
    return rows.select(
        "resume_id", "role", "skill", long("skill_ord").alias("skill_ord"), "score", "weight", "level",
        listed("matched_keywords"), listed("missing_keywords"), "semantic_similarity",
    )


LONG_CHARS = 16_000


def large_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Skill scores of the long form, and the resumes it was asked about. Texts over LONG_CHARS are cut into lines."""
    asked = identified(resumes(spark, sf_dir))
    return analyse_large(long_form.segments_of(asked, LONG_CHARS), fixtures.role_skills(spark), fixtures.SEMANTIC), asked


@registered("q_large_scores")
def large_score_rows(spark, sf_dir):
    return score_table(large_scores(spark, sf_dir)[0])


@registered("q_large_readiness")
def large_readiness(spark, sf_dir):
    scores, asked = large_scores(spark, sf_dir)
    return readiness_of(scores, known_roles(asked.drop("text"), fixtures.role_skills(spark)))


@registered("q_large_gaps")
def large_gaps(spark, sf_dir):
    return gaps_of(large_scores(spark, sf_dir)[0]).select(
        "resume_id", "role", long("priority").alias("priority"), "skill", "score", "weight", "gap", "level",
        listed("matched_keywords"), listed("missing_keywords"),
    )


@registered("q_large_study_plan")
def large_study_plan(spark, sf_dir):
    scores = stored(large_scores(spark, sf_dir)[0], "scores")
    return plan_table(plan_of(scores, fixtures.curriculum(spark)))


def letter_model() -> Callable[[Column], Column]:
    """A stand-in for a sentence encoder: how often each letter occurs, per batch in numpy."""

    def load():
        import numpy as np

        letters = "abcdefghijklmnopqrstuvwxyz"

        def predict(batch: np.ndarray) -> np.ndarray:
            lowered = [text.lower() for text in batch]
            return np.array([[text.count(letter) for letter in letters] for text in lowered], dtype=np.float64)

        return predict

    return predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=512)


@registered("q_model_provider")
def model_provider(spark, sf_dir):
    """Scores with the vectors of a model in place of hashed term counts."""
    found = stored(resumes(spark, sf_dir), "resumes")
    role_skills = fixtures.role_skills(spark)
    similarities = embeddings.model_similarities(found, role_skills, letter_model())
    scored = analyse(found, role_skills, fixtures.MODEL_SEMANTIC, similarities)
    return skill_rows(scored).select("resume_id", "skill", "score", "semantic_similarity")


def two_roles() -> Column:
    """Every resume asks for its role and for one by its number."""
    return F.array_distinct(F.array("target_role", role_by_number("resume_id")))


TWO_ROLES = ["form", "resume_id", "role", "readiness_score", "n_skills", "n_gaps", "n_hits", "gap_order", "week1_focus"]


@registered("q_two_roles")
def two_roles_in_every_form(spark, sf_dir):
    """One resume scored against two roles: row form, long form, and vectors of a model."""
    role_skills, curriculum = fixtures.role_skills(spark), fixtures.curriculum(spark)
    # a text is normalised, hashed and cut into chunks once, whatever number of roles and forms it is scored in
    found = stored(with_vectors(resumes(spark, sf_dir), role_skills, fixtures.SEMANTIC), "two-roles")
    asked = found.withColumn("target_role", F.explode(two_roles()))
    focus = F.array_join(F.get("study_plan", F.lit(0)).focus_skills, "|")

    def of_rows(form: str, analysed_: DataFrame) -> DataFrame:
        hits = F.aggregate("skills", F.lit(0).cast("bigint"), lambda n, s: n + F.size(s.matched_keywords))
        order = F.array_join(F.transform("gaps", lambda g: g.skill), "|")
        return with_plan(analysed_, curriculum).select(
            F.lit(form).alias("form"), "resume_id", F.col("target_role").alias("role"), "readiness_score", "n_skills", "n_gaps",
            hits.alias("n_hits"), order.alias("gap_order"), F.coalesce(focus, F.lit("")).alias("week1_focus"),
        )

    scores = stored(analyse_large(long_form.segments_of(asked), role_skills, fixtures.SEMANTIC), "scores")
    known = known_roles(asked.select("resume_id", "target_role"), role_skills)
    ordered = F.array_sort(F.collect_list(F.struct("priority", "skill")))
    weak = gaps_of(scores).groupBy("resume_id", "role").agg(F.array_join(F.transform(ordered, lambda g: g.skill), "|").alias("gap_order"))
    hits = scores.groupBy("resume_id", "role").agg(F.sum(F.size("matched_keywords").cast("bigint")).alias("n_hits"))
    plans = plan_of(scores, curriculum).select("resume_id", F.col("target_role").alias("role"), focus.alias("week1_focus"))
    long_rows = readiness_of(scores, known)
    for part in (weak, hits, plans):
        long_rows = long_rows.join(part, ["resume_id", "role"], "left")
    long_rows = long_rows.fillna({"gap_order": "", "week1_focus": "", "n_hits": 0}).withColumn("form", F.lit("long"))
    similarities = embeddings.model_similarities(found, role_skills, letter_model(), roles=two_roles())
    by_model = analyse(asked, role_skills, fixtures.MODEL_SEMANTIC, similarities)
    rows = of_rows("rows", analyse(asked, role_skills, fixtures.SEMANTIC))
    return rows.select(*TWO_ROLES).unionByName(long_rows.select(*TWO_ROLES)).unionByName(of_rows("model", by_model).select(*TWO_ROLES))


def with_repeats(asked: DataFrame) -> DataFrame:
    """Resumes whose ids repeat or are null; some rows come twice, alike in everything."""
    twice = F.explode(F.when(F.col("resume_id") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    number = F.when(F.col("resume_id") % 10 != 0, F.col("resume_id") - F.col("resume_id") % 3)
    return asked.withColumn("_twice", twice).drop("_twice").withColumn("resume_id", number)


@registered("q_repeated_ids")
def repeated_ids(spark, sf_dir):
    """Every row is answered for itself, in every form, where ids repeat or are null."""
    role_skills = fixtures.role_skills(spark)
    # a text is hashed once, whatever number of rows and forms it is scored in
    hashed = lambda found: with_vectors(found, role_skills, fixtures.SEMANTIC)
    asked = identified(with_repeats(hashed(resumes(spark, sf_dir))))
    plain = asked.drop("doc_key")
    scores = stored(analyse_large(long_form.segments_of(asked, LONG_CHARS), role_skills, fixtures.SEMANTIC, small=False), "scores")
    folder = scratch_dir(spark, "repeated-ids")
    arriving = with_repeats(hashed(document_stream(spark, sf_dir).where(long_enough(F.col("text")))))
    streamed = score_stream(arriving, role_skills, fixtures.SEMANTIC).selectExpr(*READINESS)
    write_stream(streamed, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    forms = {
        "rows": analyse(plain, role_skills, fixtures.SEMANTIC).selectExpr(*READINESS),
        "shuffled": analyse(plain, role_skills, fixtures.SEMANTIC, small=False).selectExpr(*READINESS),
        "long": readiness_of(scores, known_roles(asked.drop("text"), role_skills)),
        "stream": spark.read.schema(streamed.schema).parquet(f"{folder}/out"),
        "model": analyse_with_model(plain.drop("vectors"), role_skills, letter_model(), fixtures.MODEL_SEMANTIC).selectExpr(*READINESS),
    }
    found = [rows.withColumn("form", F.lit(form)) for form, rows in forms.items()]
    named = F.coalesce(F.col("resume_id").cast("string"), F.lit("none")).alias("resume_id")
    return reduce(DataFrame.unionByName, found).select("form", named, "role", "readiness_score", "n_skills", "n_gaps")


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    # a stream takes a plain path for a folder; as a pattern it may be a file as well
    arriving = spark.readStream.schema(documents.schema).parquet(f"{sf_dir}/documents.parque[t]")
    return normalised(spread(arriving, "doc_id", sized_like=documents))


@registered("q_stream_rejects")
def stream_rejects(spark, sf_dir):
    """What a stream of documents refuses, written batch by batch."""
    folder = scratch_dir(spark, "stream-rejects")
    run_stream(
        document_stream(spark, sf_dir), fixtures.role_skills(spark), folder, f"{folder}/checkpoint", fixtures.SEMANTIC
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/rejects").select("resume_id", "stage", "reason")


@registered("q_stream_readiness")
def stream_readiness(spark, sf_dir):
    """Documents read as a stream, scored and written; what was written is the result."""
    arriving = document_stream(spark, sf_dir).where(long_enough(F.col("text")))
    scored = score_stream(arriving, fixtures.role_skills(spark), fixtures.SEMANTIC).selectExpr(*READINESS)
    folder = scratch_dir(spark, "stream-readiness")
    write_stream(scored, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{folder}/out")
