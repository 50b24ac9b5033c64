"""Both physical forms agree, joins agree beyond the broadcast bound, plans have the intended shape."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from rolemeter import schemas
from rolemeter.catalog import fixtures, queries
from rolemeter.operators import dimensions, embeddings, long_form, skills
from rolemeter.operators.dimensions import is_small, lookup_join
from rolemeter.operators.skills import skill_rows
from rolemeter.plans.analysis import analyse, analyse_large, gaps_of, plan_of, readiness_of, with_plan
from rolemeter.plans.validation import known_roles, long_enough, resume_rejects, with_listing
from rolemeter.sources import pages as page_source
from rolemeter.sources.sinks import read_results, write_json, write_results
from rolemeter.streaming.readiness import run_stream, score_stream, write_stream


def rows(frame):
    return sorted(frame.select(sorted(frame.columns)).collect(), key=repr)


def shown(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.fixture
def tiny_broadcasts(monkeypatch):
    monkeypatch.setattr(dimensions, "MAX_BROADCAST_ROWS", 2)


def test_size_check(spark):
    table = spark.range(10).withColumn("t", F.lit("x" * 100))
    assert is_small(table) and not is_small(table, max_rows=9) and not is_small(table, max_bytes=500)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    big = spark.range(1000).select(F.col("id").alias("resume_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("3", 2), ("6", 3), ("none", 4)], "k string, v int")
    assert rows(lookup_join(big, table, "k", how, small=True)) == rows(lookup_join(big, table, "k", how, small=False))


def test_long_form_chunks_equal_array_chunks(spark, sf_dir):
    resumes = queries.texts(spark, sf_dir)
    odd = spark.createDataFrame(
        [(-1, "Role EN", ""), (-2, "Role EN", "tiny\n\n" * 400), (-3, "Role EN", "twelve chars"), (-4, "Role EN", "a b\nc d")],
        resumes.schema,
    )
    resumes = resumes.unionByName(odd)
    flat = embeddings.chunk_rows(resumes).select("resume_id", "chunk")
    long = long_form.chunk_rows(long_form.prepared(long_form.segments_of(resumes))).select("resume_id", "chunk")
    assert rows(flat) == rows(long)


def test_segment_offsets_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(long_form, "BLOCK", 4)
    monkeypatch.setattr(long_form, "PAGE_SHARE", 3)
    counted = spark.range(50).select(
        (F.col("id") % 2).alias("resume_id"), F.lit("R").alias("target_role"), F.col("id").alias("segment_no"), (F.col("id") % 5).alias("n")
    )
    found = {(r.resume_id, r.segment_no): (r.start, r.n_sentences) for r in long_form.segment_offsets(counted).collect()}
    for odd in (0, 1):
        before = 0
        total = sum(i % 5 for i in range(50) if i % 2 == odd)
        for i in range(odd, 50, 2):
            assert found[odd, i] == (before, total)
            before += i % 5


def test_both_forms_give_the_same_analysis(spark, sf_dir):
    resumes = queries.resumes(spark, sf_dir)
    role_skills = fixtures.role_skills(spark)
    flat = analyse(resumes, role_skills, fixtures.SEMANTIC).persist()
    scores = analyse_large(long_form.segments_of(resumes), role_skills, fixtures.SEMANTIC).persist()
    assert rows(skill_rows(flat)) == rows(scores.drop("doc_key"))
    with_skills = flat.where("n_skills > 0")
    known = known_roles(resumes.select("resume_id", "target_role"), role_skills)
    ready = flat.select("resume_id", F.col("target_role").alias("role"), "readiness_score", "readiness_tier", "n_skills", "n_gaps")
    assert rows(ready) == rows(readiness_of(scores, known))
    plans = with_plan(with_skills, fixtures.curriculum(spark)).select("resume_id", "target_role", "study_plan")
    assert rows(plans) == rows(plan_of(scores, fixtures.curriculum(spark)).select("resume_id", "target_role", "study_plan"))
    assert gaps_of(scores).count() == flat.select(F.sum("n_gaps")).first()[0]


def test_large_role_table_takes_the_other_route(spark, sf_dir, tiny_broadcasts):
    found = analyse(queries.resumes(spark, sf_dir), fixtures.role_skills(spark), fixtures.SEMANTIC)
    keep = ["resume_id", "target_role", "readiness_score", "n_skills", "n_gaps", "skills"]
    large = rows(found.select(keep))
    dimensions.MAX_BROADCAST_ROWS = 100_000
    small = rows(analyse(queries.resumes(spark, sf_dir), fixtures.role_skills(spark), fixtures.SEMANTIC).select(keep))
    assert large == small and len(large) > 150


def test_large_curriculum_is_joined_by_shuffle(spark, sf_dir, monkeypatch):
    flat = analyse(queries.resumes(spark, sf_dir), fixtures.role_skills(spark), fixtures.SEMANTIC)
    small = rows(with_plan(flat, fixtures.curriculum(spark)).select("resume_id", "study_plan"))
    monkeypatch.setattr(dimensions, "MAX_BROADCAST_ROWS", 2)
    assert small == rows(with_plan(flat, fixtures.curriculum(spark)).select("resume_id", "study_plan"))


def test_dense_queries_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    vectors = queries.labelled_vectors(spark, sf_dir)
    small = rows(embeddings.best_chunks(embeddings.chunk_similarities(*vectors)))
    monkeypatch.setattr(dimensions, "MAX_BROADCAST_ROWS", 2)
    assert small == rows(embeddings.best_chunks(embeddings.chunk_similarities(*vectors)))


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_results_do_not_depend_on_partitions(spark, sf_dir, partitions):
    expected = rows(queries.REGISTRY["q_paged_readiness"](spark, sf_dir))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows(queries.REGISTRY["q_paged_readiness"](spark, sf_dir)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_paged_documents_score_as_their_text_does(spark, sf_dir):
    from rolemeter.sources import pages

    paged = queries.paged(spark, sf_dir)
    named = lambda f: f.select(F.col("doc_id").alias("resume_id"), F.lit("Role FR").alias("target_role"), "*")
    whole = analyse(named(pages.assemble(paged)), fixtures.role_skills(spark), fixtures.SEMANTIC)
    lines = named(pages.long_document_lines(paged, max_chars=0)).select(
        "resume_id", "target_role", pages.line_order().alias("segment_no"), "gap", F.col("line").alias("text")
    )
    parts = readiness_of(analyse_large(lines, fixtures.role_skills(spark), fixtures.SEMANTIC), lines)
    keep = ["resume_id", "readiness_score", "n_skills", "n_gaps"]
    assert rows(whole.select(keep)) == rows(parts.select(keep))


def test_scoring_plan_is_local_to_the_scan(spark, sf_dir):
    scan = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    resumes = queries.normalised(scan).where(F.length("text") >= 10)
    plan = shown(analyse(resumes, fixtures.role_skills(spark), fixtures.SEMANTIC))
    above_scan = plan.split("BroadcastExchange")[0]
    assert " Exchange" not in above_scan and "Window" not in above_scan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_no_cross_joins(spark, sf_dir, name):
    plan = shown(queries.REGISTRY[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_best_chunks_are_limited_before_the_shuffle(spark, sf_dir):
    plan = shown(queries.REGISTRY["q_dense_top2"](spark, sf_dir))
    assert plan.count("WindowGroupLimit") >= 2


def test_sinks(spark, sf_dir, tmp_path):
    flat = analyse(queries.resumes(spark, sf_dir), fixtures.role_skills(spark), fixtures.SEMANTIC)
    planned = with_plan(flat, fixtures.curriculum(spark))
    write_results(planned, str(tmp_path / "out"))
    read = lambda t: read_results(spark, str(tmp_path / "out"), t)
    resumes = read("readiness")
    assert read("skill_gaps").count() == resumes.select(F.sum("n_gaps")).first()[0]
    assert read("skill_scores").count() == resumes.select(F.sum("n_skills")).first()[0]
    assert read("study_plan").count() == 4 * resumes.where("n_skills > 0").count()
    assert read("skill_scores").where("score < 5 or score > 98").count() == 0
    write_json(planned, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == resumes.count()


def test_stream_continues_where_it_stopped(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    documents.where("doc_id % 2 = 0").write.parquet(str(source))

    def run():
        arriving = queries.normalised(spark.readStream.schema(documents.schema).parquet(str(source)))
        scored = score_stream(
            arriving.where(F.length("text") >= 10), fixtures.role_skills(spark), fixtures.SEMANTIC, fixtures.curriculum(spark)
        ).select("resume_id", "readiness_score", "study_plan")
        write_stream(scored, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    run()
    documents.where("doc_id % 2 = 1").write.mode("append").parquet(str(source))
    streamed = run()
    flat = analyse(queries.resumes(spark, sf_dir), fixtures.role_skills(spark), fixtures.SEMANTIC)
    batch = with_plan(flat, fixtures.curriculum(spark)).select("resume_id", "readiness_score", "study_plan")
    assert rows(streamed) == rows(batch)


def two_requests(spark):
    """One text that asks for two roles which share a skill name, over two unlike chunks."""
    role_skills = spark.createDataFrame(
        [("A", 0, "Both", 0, 0.5, "apples pears", ["apples"]), ("A", 0, "Own", 1, 0.5, "plums", ["plums", "red plums"]),
         ("B", 1, "Both", 0, 1.0, "trains ships", ["ships"]), ("C", 2, None, None, 0.1, "", [])],
        schemas.ROLE_SKILLS,
    )
    text = "apples and pears and apples. plums or pears again here.\ntrains and ships went by. ships and trains again."
    asked = spark.createDataFrame([(7, r, text) for r in "ABC"], schemas.RESUMES)
    return asked, role_skills


def test_two_roles_of_one_resume_do_not_mix(spark, monkeypatch):
    asked, role_skills = two_requests(spark)
    keep = ["target_role", "readiness_score", "n_skills", "n_gaps", "skills"]
    whole = rows(analyse(asked, role_skills, fixtures.SEMANTIC).select(keep))
    alone = [row for r in "ABC" for row in rows(analyse(asked.where(F.col("target_role") == r), role_skills, fixtures.SEMANTIC).select(keep))]
    assert whole == sorted(alone, key=repr)
    ready = readiness_of(analyse_large(long_form.segments_of(asked), role_skills, fixtures.SEMANTIC), asked)
    assert {(r.role, r.readiness_score, r.n_skills, r.n_gaps) for r in ready.collect()} == {
        (r.target_role, r.readiness_score, r.n_skills, r.n_gaps) for r in analyse(asked, role_skills, fixtures.SEMANTIC).collect()
    }
    monkeypatch.setattr(dimensions, "MAX_BROADCAST_ROWS", 2)
    assert rows(analyse(asked, role_skills, fixtures.SEMANTIC).select(keep)) == whole


def test_vectors_of_a_text_serve_all_roles_and_forms(spark, monkeypatch):
    asked, role_skills = two_requests(spark)
    more = asked.unionByName(asked.limit(1).withColumn("text", F.lit("")).withColumn("resume_id", F.lit(8).cast("bigint")))
    keep = ["resume_id", "target_role", "readiness_score", "n_skills", "n_gaps", "skills"]
    by_skill = ["resume_id", "role", "skill", "score", "semantic_similarity"]
    whole = rows(analyse(more, role_skills, fixtures.SEMANTIC).select(keep))
    long_rows = rows(analyse_large(long_form.segments_of(more), role_skills, fixtures.SEMANTIC).select(by_skill))
    kept = skills.with_vectors(more, role_skills, fixtures.SEMANTIC).persist()
    assert kept.count() == more.count()

    def again(*_):
        raise AssertionError("hashed again")

    monkeypatch.setattr(skills, "vectors_column", again)
    assert rows(analyse(kept, role_skills, fixtures.SEMANTIC).select(keep)) == whole
    assert rows(analyse_large(long_form.segments_of(kept), role_skills, fixtures.SEMANTIC).select(by_skill)) == long_rows
    # one chunk for all roles
    letters = lambda c: F.transform(F.array(*map(F.lit, "aeiou")), lambda x: F.length(F.regexp_replace(c, F.concat(F.lit("[^"), x, F.lit("]")), "")).cast("double"))
    all_roles = F.array(*map(F.lit, "ABC"))
    each = embeddings.model_similarities(asked, role_skills, letters)
    once = embeddings.model_similarities(asked.where("target_role = 'A'"), role_skills, letters, roles=all_roles)
    plain = lambda found: sorted((r.resume_id, r.target_role, sorted(r.similarities.items())) for r in found.collect())
    assert plain(once) == plain(each) and len(plain(each)) > 1


def test_vectors_of_two_roles_do_not_mix(spark):
    chunks = spark.createDataFrame(
        [(7, r, i, v) for r in "AB" for i, v in enumerate([[1.0, 0.0], [0.0, 1.0]])],
        "resume_id long, target_role string, chunk_no int, embedding array<double>",
    )
    queries_ = spark.createDataFrame([("A", "Both", [1.0, 0.0]), ("B", "Both", [1.0, 0.0])], "role string, skill string, embedding array<double>")
    found = embeddings.stored_similarities(chunks, queries_).collect()
    assert {(r.target_role, r.similarities["Both"]) for r in found} == {("A", 0.5), ("B", 0.5)}
    asked, role_skills = two_requests(spark)
    given = spark.createDataFrame([(7, "A", {"Both": 0.9}), (7, "B", {"Both": 0.1})], "resume_id long, target_role string, similarities map<string,double>")
    scored = skill_rows(analyse(asked, role_skills, fixtures.MODEL_SEMANTIC, given))
    assert {(r.role, r.semantic_similarity) for r in scored.where("skill = 'Both'").collect()} == {("A", 0.9), ("B", 0.1)}


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_odd_documents_give_the_same_chunks_from_lines(spark, size):
    """No sentence, tabs, NBSP, double spaces, lines of 11 to 15 characters, blank space everywhere."""
    texts = [
        "", " \n\t\n ", "tiny", "tiny\nbits\n\nof  text\n \n\n", "twelve chars\nfourteen chars", "elevenchars",
        "a\u00a0b\tc  d\u200b e. Then\u00a0a sentence.\n\n\nAnd  another\tone here! Short. \u2022 bullet sentence here",
        "x\n" * 400, "x\n\n" * 400, "word " * 300, "- one two three four\n* five six seven eight\n\u2013 nine ten eleven",
    ]
    pages_ = spark.createDataFrame(
        [(i, n, part) for i, t in enumerate(texts) for n, part in enumerate(t.split("\n\n"))], "doc_id long, page_no int, page_text string"
    )
    named = lambda f: f.select(F.col("doc_id").alias("resume_id"), F.lit("R").alias("target_role"), "*")
    everything = page_source.document_sizes(pages_).withColumn("reason", F.lit(None).cast("string"))
    flat = embeddings.chunk_rows(named(page_source.assemble(pages_, everything)), size).select("resume_id", "chunk")
    lines = named(page_source.long_document_lines(pages_, everything, max_chars=-1)).select(
        "resume_id", "target_role", page_source.line_order().alias("segment_no"), "gap", F.col("line").alias("text")
    )
    whole_pages = named(page_source.page_segments(pages_, everything)).select("resume_id", "target_role", "segment_no", "gap", "text")
    filled = rows(flat)
    # a document of blanks has no line to hold its chunk
    blank = {r.doc_id for r in everything.where("n_chars = 0").collect()}
    spoken = [r for r in filled if r.resume_id not in blank]
    assert rows(long_form.chunk_rows(long_form.prepared(lines), size).select("resume_id", "chunk")) == spoken
    from_pages = rows(long_form.chunk_rows(long_form.prepared(whole_pages), size).select("resume_id", "chunk"))
    assert [r for r in from_pages if r.resume_id not in blank] == spoken


def test_a_document_of_very_many_pages_is_no_single_window(spark):
    counted = spark.range(100_000).select(
        F.lit(1).alias("resume_id"), F.lit("R").alias("target_role"), (F.col("id") * long_form.PAGE_SHARE).alias("segment_no"), F.lit(2).cast("long").alias("n")
    )
    found = long_form.segment_offsets(counted)
    assert found.agg(F.max("start"), F.min("n_sentences"), F.count_distinct("start")).first() == (199_998, 200_000, 100_000)
    groups = counted.groupBy(F.floor(F.col("segment_no") / (long_form.BLOCK * long_form.PAGE_SHARE))).count()
    assert groups.count() == 25 and groups.agg(F.max("count")).first()[0] == long_form.BLOCK


def test_closest_queries_do_not_depend_on_the_broadcast_bound(spark, sf_dir, monkeypatch):
    vectors = queries.labelled_vectors(spark, sf_dir)
    small = rows(embeddings.closest(*vectors))
    monkeypatch.setattr(dimensions, "MAX_BROADCAST_ROWS", 2)
    assert small == rows(embeddings.closest(*vectors))


def test_a_stream_with_a_large_role_table_equals_the_batch(spark, sf_dir, tmp_path, monkeypatch):
    asked = queries.texts(spark, sf_dir)
    role_skills = fixtures.role_skills(spark)
    accepted = rows(analyse(asked.where(long_enough(F.col("text"))), role_skills, fixtures.SEMANTIC).select("resume_id", "readiness_score"))
    refused = rows(with_listing(resume_rejects(asked, role_skills), role_skills).select("resume_id", "stage", "reason"))
    monkeypatch.setattr(dimensions, "MAX_BROADCAST_ROWS", 2)
    with pytest.raises(ValueError, match="run_stream"):
        score_stream(queries.document_stream(spark, sf_dir), role_skills, fixtures.SEMANTIC)
    run_stream(queries.document_stream(spark, sf_dir), role_skills, str(tmp_path / "out"), str(tmp_path / "checkpoint"), fixtures.SEMANTIC).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out/results")).select("resume_id", "readiness_score")) == accepted
    assert rows(spark.read.parquet(str(tmp_path / "out/rejects")).select("resume_id", "stage", "reason")) == refused


def test_shared_storage_is_required_beyond_one_process(spark, monkeypatch):
    from rolemeter import session

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session(), "x")
    assert session.scratch_dir(Session(), "x", "hdfs://shared/").startswith("hdfs://shared/rolemeter-app/x-")
    Context.master = "local[4]"
    assert "rolemeter-" in session.scratch_dir(Session(), "x")


def test_scratch_is_under_the_shared_folder(spark):
    from rolemeter.operators.layout import stored
    from rolemeter.session import scratch_dir

    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(shared)
    kept = stored(spark.range(3), "numbers")
    assert kept.count() == 3 and shared in kept.inputFiles()[0]


def test_a_large_scan_is_not_moved(spark, sf_dir):
    from rolemeter.operators.layout import spread

    few = spark.read.parquet(f"{sf_dir}/documents.parquet")
    many = spark.range(0, 1000, 1, 64)
    assert "REPARTITION_BY_NUM" in shown(spread(few, "doc_id"))
    assert "Exchange" not in shown(spread(many, "id"))


def test_hot_role_and_duplicate_texts_stay_spread(spark, sf_dir):
    """All documents alike and asking for one role: still one narrow stage, nothing grouped."""
    same = spark.range(0, 4000, 1, 16).select(
        F.col("id").alias("resume_id"), F.lit("Role EN").alias("target_role"), F.lit("that with this from over and out").alias("text")
    )
    scored = analyse(same, fixtures.role_skills(spark), fixtures.SEMANTIC)
    assert scored.select("readiness_score").distinct().count() == 1 and scored.rdd.getNumPartitions() == 16


@pytest.mark.parametrize("files", [0, 2])
def test_documents_arrive_from_a_file_or_a_folder_of_files(spark, tmp_path, files):
    """With 0 files the table is one Parquet file, else a folder of so many."""
    texts = ["", "Data engineer with Python and SQL.", "Knows Kubernetes and Docker well.", None]
    table = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts) for lang in ["en", "xx"]], "doc_id long, text string, lang string")
    path = tmp_path / "documents.parquet"
    table.repartition(files or 1).write.parquet(str(path if files else tmp_path / "made"))
    if not files:
        next((tmp_path / "made").glob("part-*.parquet")).rename(path)
    for streamed, plain in (("q_stream_rejects", "q_rejects"), ("q_stream_readiness", "q_readiness")):
        found = [rows(queries.REGISTRY[name](spark, str(tmp_path))) for name in (streamed, plain)]
        assert found[0] and found[0] == found[1]
