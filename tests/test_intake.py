"""Files to analysis, every file accounted for."""

from pyspark.sql import functions as F

from rolemeter.catalog import fixtures, queries
from rolemeter.plans.intake import intake, readiness_of_files
from rolemeter.plans.validation import known_roles, long_enough, with_listing
from rolemeter.sources import files as file_source
from rolemeter.sources import pages as page_source
from rolemeter.streaming.readiness import run_file_stream

FILES = {
    "a.txt": (b"that with this from\nlong enough text of words", " Role EN "),
    "b.pdf": (b"that with this|from the second page of it", "Role EN"),
    "c.pdf": (b"short|", "Role EN"),
    "d.pdf": (b"bad", "Role EN"),
    "e.docx": (b"whatever content", "Role EN"),
    "f.txt": (b"   ", "Role EN"),
    "g.txt": (b"tiny", "Role EN"),
    "h.txt": (b"a text for nobody at all", "Nobody"),
    "i.txt": (b"a text for an empty role", "Role EMPTY"),
    "j.pdf": (b"nothing", "Role EN"),
    "k.pdf": (b"locked", "Role EN"),
    "l.pdf": (b"broken", "Role EN"),
}


def page_reader():
    """Defined inside a function, so it travels to the Python workers by value."""

    def reader(content):
        if content == b"bad":
            raise ValueError("odd")
        if content == b"locked":
            raise file_source.EncryptedFile
        if content == b"broken":
            raise file_source.CorruptFile("no header")
        if content == b"nothing":
            return []
        return content.decode().split("|")

    return reader


def test_intake(spark, tmp_path, monkeypatch):
    for name, (content, _) in FILES.items():
        (tmp_path / name).write_bytes(content)
    asked = spark.createDataFrame([(n, r) for n, (_, r) in FILES.items()], "filename string, target_role string")
    files = file_source.read_files(spark, str(tmp_path)).join(asked, "filename")
    role_skills = fixtures.role_skills(spark)
    name = F.element_at(F.split("resume_id", "/"), -1)

    found = intake(files, role_skills, page_reader())
    reasons = {r[0]: r.reason for r in found.rejects.select(name, "reason").collect()}
    assert reasons["j.pdf"] == "Resume Extraction Error: The PDF document does not contain any pages."
    assert reasons["k.pdf"].endswith("Please provide an unencrypted PDF.") and reasons["l.pdf"].endswith("file stream: no header")
    rejects = {r[0]: r.stage for r in found.rejects.select(name, "stage").collect()}
    assert rejects == {
        "c.pdf": "parse", "d.pdf": "parse", "e.docx": "upload", "f.txt": "upload", "g.txt": "parse",
        "h.txt": "role", "i.txt": "plan", "j.pdf": "parse", "k.pdf": "parse", "l.pdf": "parse",
    }
    scored = readiness_of_files(found, role_skills, fixtures.SEMANTIC)
    results = {r[0]: r for r in scored.select(name.alias("name"), "readiness_score", "n_skills").collect()}
    assert set(results) == {"a.txt", "b.pdf", "i.txt"} and results["i.txt"].readiness_score == 0.0
    assert set(results) | set(rejects) == set(FILES)
    assert found.long_segments.isEmpty()

    # the same from lines, where every text is too long for one value
    monkeypatch.setattr(page_source, "MAX_ASSEMBLED_CHARS", 0)
    again = intake(files, role_skills, page_reader())
    assert again.resumes.isEmpty() and {r[0] for r in again.long_resumes.select(name).collect()} == set(results) | {"h.txt"}
    lines = {r.name: r for r in readiness_of_files(again, role_skills, fixtures.SEMANTIC).select(name.alias("name"), "readiness_score", "n_skills").collect()}
    assert lines == results
    assert {r[0]: r.stage for r in again.rejects.select(name, "stage").collect()} == rejects


def test_files_arriving_as_a_stream_equal_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, (content, _) in FILES.items():
        (folder / name).write_bytes(content)
    role_skills = fixtures.role_skills(spark)
    asked = F.when(F.col("filename") == "h.txt", "Nobody").otherwise("Role EN")
    files = lambda streaming: file_source.read_files(spark, str(folder), streaming).withColumn("target_role", asked)
    run_file_stream(
        files(True), role_skills, str(tmp_path / "out"), str(tmp_path / "checkpoint"), page_reader(), fixtures.SEMANTIC
    ).awaitTermination()
    found = intake(files(False), role_skills, page_reader())
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    scored = ["resume_id", "role", "readiness_score", "n_skills"]
    assert rows(spark.read.parquet(str(tmp_path / "out/results")).select(scored)) == rows(
        readiness_of_files(found, role_skills, fixtures.SEMANTIC).select(scored)
    )
    refused = ["resume_id", "stage", "reason"]
    assert rows(spark.read.parquet(str(tmp_path / "out/rejects")).select(refused)) == rows(
        with_listing(found.rejects, role_skills).select(refused)
    )


def test_files_of_the_tables_are_all_accounted_for(spark, sf_dir):
    uploads = queries.uploads(spark, sf_dir)
    accepted = queries.REGISTRY["q_intake_readiness"](spark, sf_dir)
    refused = queries.REGISTRY["q_intake_rejects"](spark, sf_dir)
    # a resume of a role without skills is scored and reported
    both = accepted.join(refused.where("stage = 'plan'"), "path").count()
    assert accepted.count() + refused.count() - both == uploads.count()


def test_known_roles(spark):
    asked = spark.createDataFrame([(1, "Role EN", "some longer text"), (2, "Nobody", "some longer text")], "resume_id int, target_role string, text string")
    assert [r.resume_id for r in known_roles(asked.where(long_enough(F.col("text"))), fixtures.role_skills(spark)).collect()] == [1]
