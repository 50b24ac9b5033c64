"""Documents that arrive as pages.

The text of such a document is its non-empty pages joined by a blank line, normalised. Within
a page normalisation is local, and across pages only the outermost lines need to be known. So
sizes come from partial aggregates, short documents are put together as one text, and longer
ones stay lines, whatever share of all pages one document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.functions.text import WHITESPACE, WS, normalize, squeeze, strip
from rolemeter.operators.dimensions import lookup_join

MIN_PAGED_CHARS = 20
MAX_ASSEMBLED_CHARS = 16 * 1024 * 1024

# Fixed value: the message for a paged document with too little text.
TOO_LITTLE_TEXT = (
    "Could not extract sufficient text from this PDF. "
    "The file may be a scanned image without an OCR text layer."
)


def _kept_lines(page_text: Column) -> Column:
    """Non-blank lines of a page with their line number before blank ones were dropped."""
    lines = F.transform(F.split(squeeze(page_text), "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    return F.filter(lines, lambda x: strip(x.line) != "")


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        "doc_id", F.col("page_no").cast("bigint").alias("page_no"), _kept_lines(F.col("page_text")).alias("kept")
    )


def page_lines(pages: DataFrame) -> DataFrame:
    """Non-blank lines of every page: `doc_id, page_no, line_no, line, gap`.

    `gap` tells whether the normalised text has a blank line before this one: always at the
    top of a page, elsewhere where the page had blank space.
    """
    entries = F.transform(
        "kept",
        lambda x, i: F.struct(
            x.line.alias("line"),
            ((i == 0) | (x.i > F.get(F.col("kept"), i - 1).i + 1)).alias("gap"),
        ),
    )
    return (
        _pages(pages)
        .select("doc_id", "page_no", F.posexplode(entries).alias("line_no", "entry"))
        .select("doc_id", "page_no", F.col("line_no").cast("bigint").alias("line_no"), "entry.line", "entry.gap")
    )


def line_order() -> Column:
    """Place of a line in its document as one number, whatever the page and line numbers."""
    return F.col("page_no") * F.lit(1 << 31) + F.col("line_no")


def document_sizes(pages: DataFrame) -> DataFrame:
    """Per document `n_pages`, `n_lines`, `n_chars` of its normalised text, and `reason`.

    Every page is reduced to a few numbers first; documents are then sums, minima and maxima.
    The text is its lines, a line break before each, a second one at a gap, less the two
    breaks before the first line and the space around the whole.
    """
    numbered = _pages(pages)
    line_chars = F.aggregate("kept", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x.line) + 1)
    gaps = F.size(F.filter(
        F.transform("kept", lambda x, i: (i == 0) | (x.i > F.get(F.col("kept"), i - 1).i + 1)), lambda g: g
    ))
    first = F.get("kept", F.lit(0)).line
    last = F.get("kept", F.size("kept") - 1).line
    per_page = numbered.select(
        "doc_id",
        F.when(F.size("kept") > 0, F.col("page_no")).alias("filled_page"),
        F.size("kept").cast("bigint").alias("lines"),
        (line_chars + gaps).alias("chars"),
        (F.length(first) - F.length(F.ltrim(first, F.lit(WHITESPACE)))).alias("left_pad"),
        (F.length(last) - F.length(F.rtrim(last, F.lit(WHITESPACE)))).alias("right_pad"),
    )
    per_document = per_page.groupBy("doc_id").agg(
        F.count("filled_page").alias("n_pages"),
        F.sum("lines").alias("n_lines"),
        F.coalesce(
            F.sum("chars") - 2 - F.min_by("left_pad", "filled_page") - F.max_by("right_pad", "filled_page"),
            F.lit(0),
        ).alias("n_chars"),
    )
    return per_document.withColumn(
        "reason", F.when(F.col("n_chars") < MIN_PAGED_CHARS, F.lit(TOO_LITTLE_TEXT))
    )


def _bound(max_chars: int | None) -> int:
    return MAX_ASSEMBLED_CHARS if max_chars is None else max_chars


def assemble(pages: DataFrame, sizes: DataFrame | None = None, max_chars: int | None = None) -> DataFrame:
    """`doc_id, text` of the accepted documents that are short enough to be one value.

    Longer ones are excluded before grouping, so a group is bounded by `max_chars`; take them
    from `long_document_lines`.
    """
    sizes = document_sizes(pages) if sizes is None else sizes
    left_out = sizes.where(F.col("reason").isNotNull() | (F.col("n_chars") > _bound(max_chars))).select("doc_id")
    bounded = lookup_join(
        pages.where(strip(squeeze(F.col("page_text"))) != ""), left_out, "doc_id", "left_anti", spread_by=["doc_id", "page_no"]
    )
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "page_text")))
    joined = F.array_join(F.transform(ordered, lambda p: p.page_text), "\n\n")
    return bounded.groupBy("doc_id").agg(joined.alias("joined")).select("doc_id", normalize(F.col("joined")).alias("text"))


def any_long(sizes: DataFrame, max_chars: int | None = None) -> bool:
    """Whether `assemble` leaves any accepted document out for its size."""
    return not sizes.where(F.col("reason").isNull() & (F.col("n_chars") > _bound(max_chars))).isEmpty()


def long_document_lines(
    pages: DataFrame, sizes: DataFrame | None = None, max_chars: int | None = None
) -> DataFrame:
    """Lines of the accepted documents that `assemble` leaves out for their size."""
    sizes = document_sizes(pages) if sizes is None else sizes
    long_ones = sizes.where(F.col("reason").isNull() & (F.col("n_chars") > _bound(max_chars))).select("doc_id")
    return page_lines(lookup_join(pages, long_ones, "doc_id", "left_semi", spread_by=["doc_id", "page_no"]))


def page_segments(pages: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Whole pages of the accepted documents as pieces of their normalised text.

    `doc_id, segment_no, gap, text`: space is squeezed and runs of blank lines are one, as in the
    assembled text, where a blank line separates pages.
    """
    sizes = document_sizes(pages) if sizes is None else sizes
    refused = sizes.where(F.col("reason").isNotNull()).select("doc_id")
    kept = lookup_join(pages, refused, "doc_id", "left_anti", spread_by=["doc_id", "page_no"])
    text = F.regexp_replace(squeeze(F.col("page_text")), rf"\n{WS}*\n", "\n\n")
    return kept.select(
        "doc_id", (F.col("page_no").cast("bigint") * F.lit(1 << 31)).alias("segment_no"), F.lit(True).alias("gap"), text.alias("text")
    )
