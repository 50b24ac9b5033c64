"""Text normalisation, sentence splitting and chunking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemeter.functions.core import let

# The whitespace set of Unicode-aware string stripping, as characters and as
# a regular-expression class; the bullet characters stripped from sentences; and the text
# used when there is nothing to chunk.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BULLETS = " \u2022-*\u2013\t"
EMPTY_TEXT_CHUNK = "General resume content"

MIN_SENTENCE = 10
MIN_CHUNK = 15
FALLBACK_CHARS = 500


def strip(text: Column) -> Column:
    """Trim Unicode whitespace; SQL `trim` only knows U+0020."""
    return F.btrim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """NBSP to space, zero-width space dropped, space/tab runs to one space; null to ''.

    Texts with nothing to replace, which a plain search tells, are left as they are.
    """
    text = F.coalesce(text, F.lit(""))
    mapped = F.translate(text, "\u00a0\u200b", " ")
    odd = reduce(lambda found, piece: found | F.contains(text, F.lit(piece)), ["\t", "\u00a0", "\u200b"], F.contains(text, F.lit("  ")))
    return F.when(odd, F.regexp_replace(mapped, r"[ \t]{2,}|\t", " ")).otherwise(text)


def normalize(text: Column) -> Column:
    """Squeeze, collapse blank-line runs to one blank line, strip."""
    return strip(F.regexp_replace(squeeze(text), rf"\n{WS}*\n", "\n\n"))


def sentences(text: Column) -> Column:
    """Sentences in order: cut at line ends and after . ! ?, bullets stripped, over 10 chars.

    A terminal followed by whitespace that runs across a line end is one cut, which only
    drops empty pieces, so lines and sentences are cut in a single pass over the text.
    """
    pieces = F.split(text, rf"(?<=[.!?]){WS}+|\n")
    cleaned = F.transform(pieces, lambda p: F.btrim(strip(p), F.lit(BULLETS)))
    return F.filter(cleaned, lambda s: F.length(s) > MIN_SENTENCE)


def window_starts(units: Column, size: int) -> Column:
    """Where windows of `size` sentences start, each overlapping the previous by one sentence.

    Windows whose text is too short are left out.
    """
    step = max(1, size - 1)
    starts = F.sequence(F.lit(0), F.greatest(F.size(units) - 1, F.lit(0)), F.lit(step))
    return F.filter(starts, lambda i: F.length(window_text(units, i, size)) > MIN_CHUNK)


def window_text(units: Column, start: Column, size: int) -> Column:
    return strip(F.array_join(F.slice(units, start + 1, F.lit(size)), " "))


def per_chunk(
    text: Column,
    size: int,
    of_units: Callable[[Column], Column],
    of_window: Callable[[Column, Column, Column], Column],
) -> Column:
    """An array with one value per chunk of a text.

    `of_units` turns texts into values; `of_window` makes the value of a window from the
    sentences, their values and the start. Without any window the sentences are the chunks,
    without any sentence the first characters of the text.
    """

    def from_units(units: Column, values: Column) -> Column:
        return let(
            window_starts(units, size),
            lambda starts: F.when(
                F.size(starts) > 0, F.transform(starts, lambda i: of_window(units, values, i))
            ).otherwise(values),
        )

    head = F.when(F.length(text) > 0, F.left(text, F.lit(FALLBACK_CHARS))).otherwise(F.lit(EMPTY_TEXT_CHUNK))
    return let(
        sentences(text),
        lambda units: F.when(
            F.size(units) > 0, let(of_units(units), lambda values: from_units(units, values))
        ).otherwise(of_units(F.array(head))),
    )


def chunks(text: Column, size: int = 3) -> Column:
    """Overlapping chunks of a text, with the fallbacks for texts that have no sentence."""
    return per_chunk(text, size, lambda texts: texts, lambda units, _, i: window_text(units, i, size))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def has_extension(name: Column, *extensions: str) -> Column:
    lowered = F.lower(name)
    found = F.lit(False)
    for extension in extensions:
        found = found | F.endswith(lowered, F.lit(extension))
    return found
