"""Keyword probes: the pattern of a keyword, its matches in a text and the coverage ratio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"\p{L}\p{N}"
WORD = r"\p{L}\p{N}_"

KEYWORD_TARGET = 4
RATIO_WITHOUT_KEYWORDS = 0.5


def escape(keyword: Column) -> Column:
    """Escape everything that is not a letter, digit or underscore."""
    return F.regexp_replace(keyword, rf"([^{WORD}])", r"\\$1")


def keyword_pattern(keyword: Column) -> Column:
    """Pattern for 'keyword between word boundaries, an underscore counting as one'.

    An edge that is a word character needs a neighbour that is no letter or digit. An edge
    that is punctuation has its boundary only next to a word character, so `c++` needs one
    after it. An empty keyword is found wherever any word character is. The literal comes
    first, so the search skips through the text and looks at neighbours only where it occurs.
    """
    lowered = F.lower(keyword)
    literal = escape(lowered)
    before = F.when(lowered.rlike(rf"^[{WORD}]"), F.lit(rf"(?<![{ALNUM}]")).otherwise(F.lit(rf"(?<=[{WORD}]"))
    after = F.when(lowered.rlike(rf"[{WORD}]\z"), F.lit(rf"(?![{ALNUM}])")).otherwise(F.lit(rf"(?=[{WORD}])"))
    return F.when(lowered == "", F.lit(f"[{WORD}]")).otherwise(
        F.concat(literal, before, literal, F.lit(")"), after)
    )


def probes(keywords: Column) -> Column:
    """Keywords with what is needed to look for them, computed once per role table."""
    return F.transform(
        keywords,
        lambda k: F.struct(
            k.alias("keyword"), F.lower(k).alias("needle"), keyword_pattern(k).alias("pattern")
        ),
    )


def found(lower_text: Column, probe: Column) -> Column:
    """Plain substring search first; the boundary pattern runs only where it can match."""
    return F.contains(lower_text, probe.needle) & F.regexp_like(lower_text, probe.pattern)


def partition_keywords(lower_text: Column, keyword_probes: Column) -> Column:
    """Keywords in profile order, each with a flag for whether the text has it."""
    return F.transform(
        keyword_probes,
        lambda p: F.struct(p.keyword.alias("keyword"), found(lower_text, p).alias("hit")),
    )


def flagged(flags: Column, hit: bool) -> Column:
    """The keywords whose flag is `hit`, in order."""
    chosen = F.filter(flags, lambda f: f.hit if hit else ~f.hit)
    return F.transform(chosen, lambda f: f.keyword)


def keyword_ratio(hits: Column, total: Column) -> Column:
    """Share of the target of four keywords (or all, if fewer) that was met; 0.5 without keywords."""
    target = F.greatest(F.lit(1), F.least(total, F.lit(KEYWORD_TARGET))).cast("double")
    return F.when(total == 0, F.lit(RATIO_WITHOUT_KEYWORDS)).otherwise(
        F.least(F.lit(1.0), hits.cast("double") / target)
    )
