"""Rows of one id, files of one path, equal texts, repeated arrivals and results that appear together."""

import glob
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rolemeter import schemas
from rolemeter.catalog import fixtures, queries
from rolemeter.operators import embeddings, long_form, skills
from rolemeter.operators.identity import identified, join_documents
from rolemeter.plans import analysis
from rolemeter.plans.analysis import analyse, analyse_large, analyse_with_model, gaps_of, plan_of, readiness_of, with_plan
from rolemeter.plans.intake import LostFiles, intake, readiness_of_files
from rolemeter.plans.validation import known_roles, long_enough, resume_rejects
from rolemeter.sources import files as file_source
from rolemeter.sources import sinks
from rolemeter.streaming import readiness as streaming
from tests.test_scale import rows, shown

KEEP = ["resume_id", "role", "readiness_score", "n_skills", "n_gaps"]


def repeats(spark):
    """Rows of one id with other texts, alike rows, rows without an id, one without a role."""
    text = {
        1: "that with this from here and there. a second sentence of some words.\nthen a line with them of its own and more.",
        2: "nothing of the kind in this one, only words and words. but a second sentence again.",
        3: "und der die das in einem langen Satz mit vielen Worten. noch ein Satz am Ende davon.",
    }
    asked = [("a", 1), ("a", 2), (None, 1), (None, 3), ("b", 1), ("b", 1), ("a", 3)]
    listed = [(i, "Role EN" if k < 3 else "Role DE", text[k]) for i, k in asked]
    return spark.createDataFrame([*listed, ("c", None, text[1]), ("c", "Role EMPTY", text[2])], "resume_id string, target_role string, text string")


def ready(analysed):
    return rows(analysed.withColumn("role", F.col("target_role")).select(KEEP))


def test_every_row_is_answered_for_itself_in_every_form(spark, monkeypatch):
    asked, role_skills = repeats(spark), fixtures.role_skills(spark)
    single = [r for k in range(asked.count()) for r in ready(analyse(spark.createDataFrame(asked.collect()[k : k + 1], asked.schema), role_skills, fixtures.SEMANTIC))]
    want = sorted(single, key=repr)
    assert len(want) == 8 and len({r.readiness_score for r in want}) > 2
    assert ready(analyse(asked, role_skills, fixtures.SEMANTIC)) == want
    assert ready(analyse(asked, role_skills, fixtures.SEMANTIC, small=False)) == want
    keyed = identified(asked)
    for longest in (None, 60, 0):
        scores = analyse_large(long_form.segments_of(keyed, longest), role_skills, fixtures.SEMANTIC, small=longest == 0)
        assert rows(readiness_of(scores, known_roles(keyed.drop("text"), role_skills)).select(KEEP)) == want
    plans = rows(plan_of(scores, fixtures.curriculum(spark)).select("resume_id", "study_plan"))
    assert plans == rows(with_plan(analyse(asked, role_skills, fixtures.SEMANTIC), fixtures.curriculum(spark)).where("n_skills > 0").select("resume_id", "study_plan"))
    assert gaps_of(scores).count() == sum(r.n_gaps for r in want)
    # roles in parts of one skill
    for module in (analysis, long_form):
        monkeypatch.setattr(module, "ROLE_PART", 1)
    assert ready(analyse(asked, role_skills, fixtures.SEMANTIC, small=False)) == want
    parts = analyse_large(long_form.segments_of(keyed, 60), role_skills, fixtures.SEMANTIC, small=False)
    assert rows(readiness_of(parts, known_roles(keyed.drop("text"), role_skills)).select(KEEP)) == want


def test_whole_texts_keep_their_vectors_beside_texts_cut_into_lines(spark, monkeypatch):
    asked, role_skills = repeats(spark), fixtures.role_skills(spark)
    want = ready(analyse(asked, role_skills, fixtures.SEMANTIC))
    keyed = identified(skills.with_vectors(asked, role_skills, fixtures.SEMANTIC))
    cut = long_form.segments_of(keyed, 90).select("whole", F.col("vectors").isNotNull().alias("given")).distinct().collect()
    assert {(r.whole, r.given) for r in cut} == {(True, True), (False, False)}

    def again(*_):
        raise AssertionError("hashed again")

    monkeypatch.setattr(skills, "vectors_column", again)
    for longest in (None, 90, 0):
        scores = analyse_large(long_form.segments_of(keyed, longest), role_skills, fixtures.SEMANTIC, small=False)
        assert rows(readiness_of(scores, known_roles(keyed.drop("text"), role_skills)).select(KEEP)) == want


def test_repeated_ids_hash_a_text_once_a_source(spark, sf_dir, monkeypatch):
    hashed, column = [], skills.vectors_column

    def counted(*parameters):
        hashed.append(parameters)
        return column(*parameters)

    monkeypatch.setattr(skills, "vectors_column", counted)
    found = queries.REGISTRY["q_repeated_ids"](spark, sf_dir).groupBy("form").count().collect()
    assert len(found) == 5 and len({r["count"] for r in found}) == 1
    # the stored texts and those of the stream, whatever number of forms and rows
    assert len(hashed) == 2


def test_vectors_of_a_model_do_not_mix_rows_of_one_id(spark):
    asked, role_skills = repeats(spark), fixtures.role_skills(spark)
    model = queries.letter_model()
    found = ready(analyse_with_model(asked, role_skills, model, fixtures.MODEL_SEMANTIC))
    single = [r for x in asked.collect() for r in ready(analyse_with_model(spark.createDataFrame([x], asked.schema), role_skills, model, fixtures.MODEL_SEMANTIC))]
    assert found == sorted(single, key=repr)


def test_facts_without_a_key_meet_null_ids(spark):
    left = spark.createDataFrame([(None, "r", 1), ("x", None, 2), ("x", "r", 3)], "resume_id string, target_role string, v int")
    facts = spark.createDataFrame([(None, "r", 10), ("x", None, 20)], "resume_id string, target_role string, f int")
    assert {(r.v, r.f) for r in join_documents(left, facts).collect()} == {(1, 10), (2, 20), (3, None)}


def test_whole_documents_move_at_most_once(spark, sf_dir):
    asked = queries.resumes(spark, sf_dir)
    plan = shown(analyse(asked, fixtures.role_skills(spark), fixtures.SEMANTIC, small=False))
    above = plan[: plan.index("===") if "===" in plan else None]
    assert above.count("SortMergeJoin") + above.count("ShuffledHashJoin") <= 2 and "Window" not in above


def test_no_text_moves_for_pieces_of_documents(spark):
    cut = long_form.prepared(long_form.segments_of(identified(repeats(spark)), 0))
    plan = shown(long_form.chunk_vectors(cut.where("n > 0"), 3, 256))
    moved = [part for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0]]
    assert moved and all("text#" not in part for part in moved)


def seen_by(folder):
    """A model that leaves a file with the texts of every batch it gets."""

    def embed(texts: pd.Series) -> pd.Series:
        import uuid

        if len(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.writelines(f"{hash(t)}\n" for t in texts)
        return texts.map(lambda t: [float(t.count(c)) + 0.5 for c in "abcdefgh"])

    embed.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return pandas_udf(embed, "array<double>")


def texts_seen(folder):
    return sum(len(open(path).readlines()) for path in glob.glob(f"{folder}/*"))


def test_a_model_sees_each_text_once(spark, tmp_path):
    asked = repeats(spark).unionByName(repeats(spark))
    role_skills = fixtures.role_skills(spark)
    seen, again, vectors = (str(tmp_path / n) for n in ("seen", "again", "vectors"))
    for folder in (seen, again):
        os.mkdir(folder)
    first = ready(analyse_with_model(asked, role_skills, seen_by(seen), fixtures.MODEL_SEMANTIC, vectors))
    chunks = embeddings.chunk_rows(asked).select("chunk").distinct().count()
    n_queries = queries.query_text(role_skills.where(F.col("skill").isNotNull())).select("query_text").distinct().count()
    assert texts_seen(seen) == chunks + n_queries
    more = asked.unionByName(spark.createDataFrame([("z", "Role EN", "a text that no run before has seen at all, of one sentence")], asked.schema))
    second = ready(analyse_with_model(more, role_skills, seen_by(again), fixtures.MODEL_SEMANTIC, vectors))
    assert texts_seen(again) == 1 and len(second) == len(first) + 1 and set(map(repr, first)) <= set(map(repr, second))


def lines_or_worse():
    def failing():
        raise ValueError("odd page")

    def read(content):
        parts = content.decode().split("|")
        return (failing if p == "odd" else p for p in parts)

    return read


FILES = [
    ("p/one.pdf", "that with this from the first page|and the second page of it"), ("p/one.pdf", "another text of the same path|and more of it here"),
    (None, "a file that has no path at all|but two pages of text"), ("q.txt", "a plain text that comes twice over"), ("q.txt", "a plain text that comes twice over"),
    ("r.pdf", "the good page of this file is long enough|odd|and the last one"), (None, ""), ("s.pdf", "short"),
]


def test_files_of_one_path_or_none_are_answered_one_by_one(spark):
    files = spark.createDataFrame(
        [(p, "x.pdf" if p is None else p.rpartition("/")[2], bytearray(c.encode()), "Role EN") for p, c in FILES], "path string, filename string, content binary, target_role string",
    )
    found = intake(files, fixtures.role_skills(spark), lines_or_worse())
    texts = sorted(((r.resume_id, r.text) for r in found.resumes.collect()), key=repr)
    want = [(p, c.replace("|odd", "").replace("|", "\n\n")) for p, c in FILES[:6]]
    assert texts == sorted(want, key=repr)
    refused = sorted(((r.resume_id, r.stage) for r in found.rejects.collect()), key=repr)
    assert refused == sorted([(None, "upload"), ("s.pdf", "parse")], key=repr)
    assert (found.counts["files"], found.counts["accepted"], found.counts["rejected"]) == (8, 6, 2)
    scored = readiness_of_files(found, fixtures.role_skills(spark), fixtures.SEMANTIC)
    assert sorted(r.resume_id or "" for r in scored.collect()) == sorted(p or "" for p, _ in FILES[:6])


def test_a_lost_file_stops_the_run(spark, monkeypatch):
    files = spark.createDataFrame([(f"{i}.pdf", f"{i}.pdf", bytearray(b"text of a page"), "Role EN") for i in range(5)], "path string, filename string, content binary, target_role string")
    real = file_source.read_pages
    monkeypatch.setattr(file_source, "read_pages", lambda pdfs, extract, key: real(pdfs.limit(4), extract, key))
    with pytest.raises(LostFiles, match="5 files came in, 4 were read"):
        intake(files, fixtures.role_skills(spark), lines_or_worse())


def test_a_resume_that_arrives_again_counts_once(spark, tmp_path):
    role_skills = fixtures.role_skills(spark)
    texts = [r.text for r in repeats(spark).collect()]
    arrivals = [  # by batch: id, role, text, arrived
        [("a", "Role EN", texts[0], 1), ("a", "Role EN", texts[1], 2), (None, "Role EN", texts[0], 1), ("b", "Role EN", texts[0], 1)],
        [("a", "Role EN", texts[3], 5), (None, "Role EN", texts[1], 2), ("c", "Role EN", "tiny", 2), ("b", "Role DE", texts[0], 3)],
        [("a", "Role EN", texts[0], 4), ("b", "Role EN", "tiny", 9), ("c", "Role EN", texts[0], 3)],
    ]
    schema = "resume_id string, target_role string, text string, arrived int"
    for batch in arrivals:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streaming.run_stream(stream, role_skills, str(tmp_path / "out"), str(tmp_path / "checkpoint"), fixtures.SEMANTIC, arrived="arrived").awaitTermination()
    results, rejects = streaming.latest(spark, str(tmp_path / "out"))
    last = {}
    for row in sorted((r for batch in arrivals for r in batch), key=lambda r: r[3]):
        last[row[:2]] = row
    asked = spark.createDataFrame([r[:3] for r in last.values()], schemas.RESUMES.fromJson(repeats(spark).schema.jsonValue()))
    assert ready(results) == ready(analyse(asked.where(long_enough(F.col("text"))), role_skills, fixtures.SEMANTIC))
    assert rows(rejects.select("resume_id", "stage")) == rows(resume_rejects(asked, role_skills).select("resume_id", "stage"))


def test_results_appear_together_or_not_at_all(spark, tmp_path, monkeypatch):
    planned = with_plan(analyse(repeats(spark), fixtures.role_skills(spark), fixtures.SEMANTIC), fixtures.curriculum(spark))
    folder = str(tmp_path / "out")
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "gap_rows", lambda rows: rows.select(F.raise_error(F.lit("stop")).alias("x")))
        with pytest.raises(Exception, match="stop"):
            sinks.write_results(planned, folder)
    with pytest.raises(sinks.NotCommitted):
        sinks.read_results(spark, folder, "readiness")
    sinks.write_results(planned, folder)
    with pytest.raises(FileExistsError):
        sinks.write_results(planned, folder)
    once = {t: sinks.read_results(spark, folder, t).count() for t in sinks.TABLES}
    assert once["readiness"] == once["analysis"] == 8 and once["study_plan"] == 28
    sinks.write_results(planned, folder, "append")
    assert {t: sinks.read_results(spark, folder, t).count() for t in sinks.TABLES} == {t: 2 * n for t, n in once.items()}
    sinks.write_results(planned.limit(1), folder, "overwrite")
    assert sinks.read_results(spark, folder).count() == 1
    assert len(sinks.drop_replaced(spark, folder)) == 3 and sinks.read_results(spark, folder, "readiness").count() == 1
