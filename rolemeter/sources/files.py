"""Uploaded files: scan, format choice, text decoding and the checks of each step."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemeter import schemas
from rolemeter.functions.text import has_extension, normalize
from rolemeter.operators.layout import computed_once
from rolemeter.session import ship

# A page of a file: its text, or a function that reads it.
Page = str | Callable[[], str]

MIN_TXT_CHARS = 10

# The messages a rejected upload is reported with.
NO_FILE = "No file uploaded. Please upload a valid .pdf or .txt resume."
UNSUPPORTED = "Unsupported file format '%s'. Allowed formats: .pdf, .txt"
EMPTY_FILE = "The uploaded file is empty (0 bytes)."
EXTRACTION = "Resume Extraction Error: "
UNREADABLE_TXT = EXTRACTION + "The text file is empty or contains no readable text content."
FAILED_PDF = EXTRACTION + "Failed to process PDF file: "
CORRUPT_PDF = EXTRACTION + "Corrupt or invalid PDF file stream: "
ENCRYPTED_PDF = EXTRACTION + "The PDF file is encrypted and password-protected. Please provide an unencrypted PDF."
NO_PAGES = EXTRACTION + "The PDF document does not contain any pages."


class CorruptFile(Exception):
    """A caller's reader raises this for a file that is no valid PDF."""


class EncryptedFile(Exception):
    """A caller's reader raises this for a file it has no password for."""


def read_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Files of a folder as `filename`, `content`."""
    reader = spark.readStream if streaming else spark.read
    files = reader.format("binaryFile").schema(schemas.FILES).option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content"
    )


def decode_txt(content: Column) -> Column:
    """UTF-8 when the bytes are valid UTF-8, else Latin-1, which accepts any bytes."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def upload_reason(filename: Column, content: Column) -> Column:
    """Why an upload is refused before it is read; null when it is not. First check wins."""
    blank = content.isNull() | ~content.cast("string").rlike(r"[^ \t\n\r\x0b\x0c]")
    return F.coalesce(
        F.when(F.coalesce(filename, F.lit("")) == "", F.lit(NO_FILE)),
        F.when(~has_extension(filename, ".pdf", ".txt"), F.format_string(UNSUPPORTED, filename)),
        F.when(blank, F.lit(EMPTY_FILE)),
    )


def check_uploads(files: DataFrame) -> DataFrame:
    """Files with the reason they are refused at upload, null for accepted ones."""
    return files.withColumn("reason", upload_reason(F.col("filename"), F.col("content")))


def classified(files: DataFrame) -> DataFrame:
    """The outcome of every file from one reading of its content.

    All columns but the content, and `stage, reason` of a refused file, `text` of a TXT file, or
    `pdf`, the content of a PDF file that is still to be read.
    """
    kept = [c for c in files.columns if c not in ("content", "reason")]
    accepted = F.col("reason").isNull()
    checked = check_uploads(files).withColumn("is_txt", F.coalesce(accepted & has_extension(F.col("filename"), ".txt"), F.lit(False)))
    decoded = computed_once(checked, "text", F.when(F.col("is_txt"), normalize(decode_txt(F.col("content")))))
    too_short = F.col("is_txt") & (F.length("text") < MIN_TXT_CHARS)
    return decoded.select(
        *kept,
        F.when(~accepted, F.lit("upload")).when(too_short, F.lit("parse")).alias("stage"),
        F.coalesce("reason", F.when(too_short, F.lit(UNREADABLE_TXT))).alias("reason"),
        F.when(~too_short, F.col("text")).alias("text"),
        F.when(accepted & ~F.col("is_txt"), F.col("content")).alias("pdf"),
    )


def txt_documents(files: DataFrame) -> DataFrame:
    """Accepted TXT files with their normalised `text`."""
    return classified(files).where(F.col("text").isNotNull()).drop("stage", "reason", "pdf")


def file_rejects(files: DataFrame) -> DataFrame:
    """Rows for the quarantine table: refused uploads and unreadable texts."""
    return classified(files).where(F.col("reason").isNotNull()).drop("text", "pdf")


def pdf_pages(files: DataFrame, extract: Callable[[bytes], Iterable[Page]] | None = None) -> DataFrame:
    """Pages of the accepted PDF files among `files`, see `read_pages`."""
    pdfs = classified(files).where(F.col("pdf").isNotNull())
    return read_pages(pdfs.select("path", F.col("pdf").alias("content")), extract)


def read_pages(pdfs: DataFrame, extract: Callable[[bytes], Iterable[Page]] | None = None, key: str = "path") -> DataFrame:
    """Pages of PDF files (`key, content`) as `key, page_no, page_text, reason`.

    `extract` is the caller's reader: the pages of the bytes of one file, each a text or a function that
    gives it. A page whose function fails is skipped, as if it were empty. A file that cannot be
    read, or that has no pages, gives one row with the reason, so none is lost, and none stops
    the job. Files are read and given on one by one; how many contents a task holds is set by
    `spark.sql.execution.arrow.maxRecordsPerBatch`. Without a reader every PDF file is refused.
    """
    reasons = (NO_PAGES, ENCRYPTED_PDF, CORRUPT_PDF, FAILED_PDF)
    ship(pdfs.sparkSession)

    def text_of(page: Page) -> str | None:
        if not callable(page):
            return page
        try:
            return page()
        except Exception:
            return None

    def rows(name, content: bytes) -> list[tuple]:
        no_pages, encrypted, corrupt, failed = reasons
        try:
            if extract is None:
                raise RuntimeError("no PDF reader was given")
            pages = [text_of(page) for page in extract(bytes(content))]
        except EncryptedFile:
            return [(name, 0, None, encrypted)]
        except CorruptFile as error:
            return [(name, 0, None, corrupt + str(error))]
        except Exception as error:
            return [(name, 0, None, failed + str(error))]
        return [(name, i, text, None) for i, text in enumerate(pages)] or [(name, 0, None, no_pages)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                found = rows(name.as_py(), content.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found), (batch.schema.types[0], pa.int32(), pa.string(), pa.string()), strict=True)],
                    names=[key, "page_no", "page_text", "reason"],
                )

    kind = pdfs.schema[key].dataType.simpleString()
    return pdfs.select(key, "content").mapInArrow(read, f"`{key}` {kind}, page_no int, page_text string, reason string")
