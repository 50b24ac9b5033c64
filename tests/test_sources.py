"""Files, pages and profiles."""

import json

from pyspark.sql import functions as F

from rolemeter import schemas
from rolemeter.sources import files as S
from rolemeter.sources import pages as P
from rolemeter.sources import profiles as R


def write(folder, name, content):
    (folder / name).write_bytes(content)


def test_files_are_read_checked_and_decoded(spark, tmp_path):
    write(tmp_path, "a.txt", "Hello world, résumé".encode())
    write(tmp_path, "B.TXT", "latin résumé text".encode("latin-1"))
    write(tmp_path, "c.docx", b"something")
    write(tmp_path, "d.txt", b" \n\t ")
    write(tmp_path, "e.txt", b"tiny")
    files = S.read_files(spark, str(tmp_path))
    texts = {r.filename: r.text for r in S.txt_documents(files).collect()}
    assert texts == {"a.txt": "Hello world, résumé", "B.TXT": "latin résumé text"}
    rejects = {r.filename: (r.stage, r.reason) for r in S.file_rejects(files).collect()}
    assert rejects == {
        "c.docx": ("upload", "Unsupported file format 'c.docx'. Allowed formats: .pdf, .txt"),
        "d.txt": ("upload", S.EMPTY_FILE),
        "e.txt": ("parse", S.UNREADABLE_TXT),
    }


def test_missing_name_and_empty_content(spark):
    rows = [("", b"some content here"), (None, b"some content here"), ("x.txt", b""), ("x.txt", None)]
    files = spark.createDataFrame(rows, "filename string, content binary")
    assert [r.reason for r in S.check_uploads(files).collect()] == [S.NO_FILE, S.NO_FILE, S.EMPTY_FILE, S.EMPTY_FILE]


def test_pdf_pages_with_a_supplied_reader(spark):
    def reader(content):
        if content.startswith(b"bad"):
            raise ValueError("broken")
        return content.decode().split("|")

    rows = [("a.pdf", b"one|two"), ("b.PDF", b"bad"), ("c.txt", b"text file here")]
    files = spark.createDataFrame(rows, "filename string, content binary").withColumn("path", F.col("filename"))
    found = sorted(tuple(r) for r in S.pdf_pages(files, reader).collect())
    assert found == [
        ("a.pdf", 0, "one", None), ("a.pdf", 1, "two", None),
        ("b.PDF", 0, None, S.FAILED_PDF + "broken"),
    ]


PAGES = [
    (1, 0, "  First page \n\n\n second line"), (1, 1, ""), (1, 2, " \n "), (1, 3, "\n third page  text \n"),
    (2, 0, "short"), (3, 0, None), (3, 1, ""), (4, 0, " only  one line, long enough "),
]


def test_page_assembly_and_sizes(spark):
    pages = spark.createDataFrame(PAGES, schemas.PAGES)
    texts = {r.doc_id: r.text for r in P.assemble(pages).collect()}
    assert texts == {1: "First page \n\n second line\n\n third page text", 4: "only one line, long enough"}
    sizes = {r.doc_id: (r.n_pages, r.n_lines, r.n_chars, r.reason is None) for r in P.document_sizes(pages).collect()}
    assert sizes == {1: (2, 3, len(texts[1]), True), 2: (1, 1, 5, False), 3: (0, 0, 0, False), 4: (1, 1, 26, True)}


def test_long_documents_stay_lines(spark):
    pages = spark.createDataFrame(PAGES, schemas.PAGES)
    assert [r.doc_id for r in P.assemble(pages, max_chars=30).collect()] == [4]
    lines = P.long_document_lines(pages, max_chars=30).orderBy("page_no", "line_no").collect()
    assert [(r.page_no, r.line_no, r.line, r.gap) for r in lines] == [
        (0, 0, " First page ", True), (0, 1, " second line", True), (3, 0, " third page text ", True),
    ]


PROFILE_TEXT = """{
  "B role": {"title": "B", "description": "", "skills": {
     "z": {"weight": "0.4", "description": "d", "keywords": ["k1", "k2"]},
     "a": {},
     "z2": {"weight": 2}}},
  "A role": {"title": "A", "skills": {"x": {"weight": 0.1}, "y": {"weight": 0.5}, "x": {"weight": 0.9}}},
  "empty": {"skills": {}}
}"""


def test_profiles_keep_order_and_defaults(spark, tmp_path):
    (tmp_path / "profiles.json").write_text(PROFILE_TEXT)
    rows = R.read_profiles(spark, str(tmp_path / "profiles.json")).orderBy("role_ord", "skill_ord").collect()
    assert [(r.role, r.skill, r.weight, r.description, r.keywords) for r in rows] == [
        ("B role", "z", 0.4, "d", ["k1", "k2"]), ("B role", "a", 0.1, "", []), ("B role", "z2", 2.0, "", []),
        ("A role", "x", 0.9, "", []), ("A role", "y", 0.5, "", []),
        ("empty", None, 0.1, "", []),
    ]


def test_query_text_uses_six_keywords(spark):
    row = ("r", 0, "SQL", 0, 0.1, "desc", list("abcdefgh"))
    skills = spark.createDataFrame([row], schemas.ROLE_SKILLS)
    assert R.query_text(skills).first().query_text == "SQL: desc. Keywords: a, b, c, d, e, f."


def test_role_listing(spark, tmp_path):
    (tmp_path / "p.json").write_text(PROFILE_TEXT)
    listing = R.role_listing(R.read_profiles(spark, str(tmp_path / "p.json"))).orderBy("role_ord").collect()
    assert [(r.role, r.n_skills, r.n_keywords) for r in listing] == [("B role", 3, 2), ("A role", 2, 0), ("empty", 0, 0)]


def test_curriculum_is_a_table(spark, tmp_path):
    row = {"skill": "s", "fundamentals": "f", "applied": "a", "project": "p", "topics": ["1", "2", "3"]}
    (tmp_path / "c.json").write_text(json.dumps(row))
    assert R.read_curriculum(spark, str(tmp_path / "c.json")).first().topics == ["1", "2", "3"]
