"""Scoring of documents that are no single value, in pieces.

A document is any number of segments (pages, lines; a plain text is one), and `doc_key` tells whose
a segment is. Where one segment is the whole document, everything happens in its row, as in
`operators.skills`. Else the sentences of a document are numbered over its segments, cut into
windows and hashed before they move, so groups are the few sentences of a window, the two best
chunks of a skill, the keywords of a skill. A role is a row of its skills, or several if it has very
many; it is broadcast where its table's size was checked, else both sides shuffle, salted.

Segments are `resume_id, target_role, segment_no, gap, text`, with `doc_key` and `whole` if known.
Without a key a resume and its role are a document; nulls are equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemeter.functions.keywords import flagged, found
from rolemeter.functions.text import (
    FALLBACK_CHARS, MIN_CHUNK, WHITESPACE, WS, EMPTY_TEXT_CHUNK, normalize, sentences, squeeze, strip, tokens,
)
from rolemeter.functions.vectors import buckets, only_buckets, sparse_cosine, sparse_vector, with_norm
from rolemeter.operators.dimensions import lookup_join
from rolemeter.operators.embeddings import best_chunks
from rolemeter.operators.identity import DOC_KEY, document_columns, join_documents
from rolemeter.operators.layout import stored
from rolemeter.operators.skills import ROLE_PART, Semantic, finished, role_rows, score_skills, skill_rows, with_role
from rolemeter.sources.pages import page_lines, line_order

BLOCK = 4096
# Lines of a page are numbered within a page's share of the numbers, see `pages.line_order`.
PAGE_SHARE = 1 << 31
# A non-blank segment has at least one character and one line break before the next one.
HEAD_SEGMENTS = FALLBACK_CHARS // 2 + 1


def segments_of(resumes: DataFrame, longest: int | None = None) -> DataFrame:
    """Plain resumes as documents of one segment, each row one of its own, whatever its id.

    With `longest`, texts of more characters become segments of a line each. Whole texts keep `vectors` they have.
    """
    keyed = resumes if DOC_KEY in resumes.columns else resumes.withColumn(DOC_KEY, F.monotonically_increasing_id())
    own = document_columns(keyed)
    short = keyed if longest is None else keyed.where(F.length("text") <= longest)
    given = _given(keyed)
    whole = short.select(*own, F.lit(0).cast("bigint").alias("segment_no"), F.lit(True).alias("gap"), "text", F.lit(True).alias("whole"), *given)
    if longest is None:
        return whole
    if DOC_KEY not in resumes.columns:
        raise ValueError("cut into lines, resumes need the doc_key that identified() gives them")
    long = keyed.where(F.length("text") > longest)
    lines = page_lines(long.select(F.struct(*own).alias("doc_id"), F.lit(0).alias("page_no"), F.col("text").alias("page_text")))
    none = [F.lit(None).cast(keyed.schema[c].dataType).alias(c) for c in given]
    return whole.unionByName(lines.select("doc_id.*", line_order().alias("segment_no"), "gap", F.col("line").alias("text"), F.lit(False).alias("whole"), *none))


def _given(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c == "vectors"]


def document_key(segments: DataFrame) -> DataFrame:
    """Segments with a `doc_key`; without one, it stands for the resume and its role, nulls included."""
    if DOC_KEY in segments.columns:
        return segments
    return segments.withColumn(DOC_KEY, F.unhex(F.md5(F.to_json(F.struct("resume_id", "target_role")))))


def _key(rows: DataFrame) -> list[str]:
    return [DOC_KEY] if DOC_KEY in rows.columns else document_columns(rows)


def segment_offsets(counted: DataFrame) -> DataFrame:
    """Sentences before each segment and in its whole document.

    `counted` is the document's key, `segment_no` and `n`. The running sum has three levels, so no
    window holds a document with very many segments: segments in a block, blocks in a group of
    BLOCK pages, groups. A document of a hundred thousand one-line pages has 25 groups.
    """
    key = _key(counted)
    blocks = counted.withColumn("block", F.floor(F.col("segment_no") / BLOCK)).withColumn(
        "pages", F.floor(F.col("segment_no") / (BLOCK * PAGE_SHARE))
    )

    def running(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))

    per_block = blocks.groupBy(*key, "pages", "block").agg(F.sum("n").alias("block_n"))
    per_group = per_block.groupBy(*key, "pages").agg(F.sum("block_n").alias("group_n"))
    totals = per_group.groupBy(*key).agg(F.sum("group_n").alias("n_sentences"))
    groups = running(per_group, key, "pages", "group_n", "group_start").drop("group_n")
    inner = running(per_block, [*key, "pages"], "block", "block_n", "block_start").drop("block_n")
    starts = inner.join(groups, [*key, "pages"]).join(totals, key)
    placed = running(blocks, [*key, "block"], "segment_no", "n", "inside").join(starts.drop("pages"), [*key, "block"])
    start = F.col("group_start") + F.col("block_start") + F.col("inside")
    return placed.select(*key, "segment_no", start.alias("start"), "n_sentences")


def prepared(segments: DataFrame, pieces_only: bool = False) -> DataFrame:
    """Segments with their document's key and the number of their sentences, stored, as scoring reads them several times.

    Texts are pieces of a normalised document: a plain resume, or pages or lines as
    `sources.pages` gives them. `gap` tells whether a blank line comes before a segment, `whole`
    whether it is all of its document. With `pieces_only`, sentences are counted only of those that are not.
    """
    if "n" in segments.columns:
        return segments
    keyed = document_key(segments)
    gap = F.col("gap") if "gap" in segments.columns else F.lit(True).alias("gap")
    whole = F.col("whole") if "whole" in segments.columns else F.lit(False).alias("whole")
    n = F.size(sentences(F.col("text")))
    if pieces_only and "whole" in segments.columns:
        n = F.when(~F.col("whole"), n)
    return stored(keyed.select(*document_columns(keyed), "segment_no", gap, "text", whole, n.alias("n"), *_given(keyed)), "segments")


def documents_of(cut: DataFrame) -> DataFrame:
    """`doc_key, resume_id, target_role` of the documents of prepared segments."""
    names = document_columns(cut)
    pieces = cut.where(~F.col("whole")).select(*names).distinct()
    return cut.where("whole").select(*names).unionByName(pieces)


def sentence_rows(cut: DataFrame, value: Callable[[Column], Column]) -> DataFrame:
    """The document, `sentence_no`, numbered through it, `value` of the sentence, and `n_sentences` of the document."""
    names = document_columns(cut)
    filled = cut.where("n > 0")
    offsets = segment_offsets(filled.select(DOC_KEY, "segment_no", F.col("n").cast("bigint").alias("n")))
    cut_up = filled.select(*names, "segment_no", F.posexplode(F.transform(sentences(F.col("text")), value)).alias("pos", "value"))
    return cut_up.join(offsets, [DOC_KEY, "segment_no"]).select(
        *names, (F.col("start") + F.col("pos")).alias("sentence_no"), "value", "n_sentences"
    )


def document_heads(cut: DataFrame) -> DataFrame:
    """Chunk of documents without any sentence: the first characters of their text."""
    names = document_columns(cut)
    some = cut.where("n > 0").select(DOC_KEY).distinct()
    opening = F.regexp_replace(squeeze(F.col("text")), rf"\A({WS}*\n)+", "")
    top = F.left(F.regexp_replace(opening, rf"\n{WS}*\n", "\n\n"), F.lit(FALLBACK_CHARS + 2))
    without = cut.where("n = 0").select(*names, "segment_no", "gap", top.alias("top")).join(some, DOC_KEY, "left_anti")
    # Blank segments add nothing; they are ranked last so that a document of blanks keeps one.
    blank = strip(F.col("top")) == ""
    order = Window.partitionBy(DOC_KEY).orderBy(blank, "segment_no")
    between = F.transform("tops", lambda t: F.concat(F.when(t.gap, F.lit("\n\n")).otherwise(F.lit("\n")), t.top))
    joined = normalize(F.array_join(between, ""))
    return (
        without.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= HEAD_SEGMENTS)
        .groupBy(*names)
        .agg(F.array_sort(F.collect_list(F.when(~blank, F.struct("segment_no", "gap", "top")))).alias("tops"))
        .select(
            *names, F.lit(0).cast("bigint").alias("chunk_no"),
            F.when(F.length(joined) > 0, F.left(joined, F.lit(FALLBACK_CHARS))).otherwise(F.lit(EMPTY_TEXT_CHUNK)).alias("chunk"),
        )
    )


def windows(cut: DataFrame, size: int, value: Callable[[Column], Column]) -> DataFrame:
    """The document, `chunk_no`, the `parts` (`sentence_no`, `value`, in order) of every window, and whether they are `enough`.

    Every sentence joins the one or two windows it belongs to, so a group is one window. A
    document all of whose windows are too short keeps its sentences; other short windows are left out.
    """
    def measured(sentence: Column) -> Column:
        length = F.length(sentence)
        return F.struct(
            value(sentence).alias("value"), length.alias("length"),
            (length - F.length(F.ltrim(sentence, F.lit(WHITESPACE)))).alias("lead"), (length - F.length(F.rtrim(sentence, F.lit(WHITESPACE)))).alias("trail"),
        )

    names = document_columns(cut)
    step = max(1, size - 1)
    number = F.col("sentence_no")
    own = F.floor(number / step)
    also_previous = (number % step == 0) & (number > 0) & F.lit(size > step)
    members = F.when(also_previous, F.array(own, own - 1)).otherwise(F.array(own))
    grouped = (
        sentence_rows(cut, measured)
        .withColumn("chunk_no", F.explode(members))
        .groupBy(*names, "chunk_no")
        .agg(
            F.sort_array(F.collect_list(F.struct("sentence_no", "value.value", "value.length", "value.lead", "value.trail"))).alias("parts"),
            F.max("n_sentences").alias("n_sentences"),
        )
    )
    length = F.aggregate("parts", F.lit(-1), lambda n, p: n + p.length + 1) - F.get("parts", F.lit(0)).lead - F.get("parts", F.size("parts") - 1).trail
    found_ = grouped.withColumn("enough", length > MIN_CHUNK)
    if size > 1:
        # Two sentences exceed the minimum, so only a single sentence can be left over whole.
        found_ = found_.withColumn("only_short", F.col("n_sentences") == 1)
    else:
        short = found_.groupBy(DOC_KEY).agg((~F.bool_or("enough")).alias("only_short"))
        found_ = found_.join(short, DOC_KEY)
    return found_.where(F.col("only_short") | F.col("enough")).drop("only_short", "n_sentences")


def chunk_rows(cut: DataFrame, size: int = 3) -> DataFrame:
    """Chunks of prepared segments, over their borders: `doc_key, resume_id, target_role, chunk_no, chunk`.

    `chunk_no` orders the chunks of a document; it can have gaps where a window was too short.
    """
    joined = F.array_join(F.transform("parts", lambda p: p.value), " ")
    kept = windows(cut, size, lambda s: s).select(
        *document_columns(cut), "chunk_no", F.when(F.col("enough"), strip(joined)).otherwise(joined).alias("chunk")
    )
    return kept.unionByName(document_heads(cut))


def chunk_vectors(cut: DataFrame, size: int, dim: int) -> DataFrame:
    """Hashed vectors `v` of the chunks of prepared segments. Sentences move as their buckets, never as text."""
    names = document_columns(cut)
    gathered = F.sort_array(F.flatten(F.transform("parts", lambda p: p.value)))
    kept = windows(cut, size, lambda s: buckets(tokens(s), dim)).select(*names, "chunk_no", with_norm(gathered).alias("v"))
    return kept.unionByName(document_heads(cut).select(*names, "chunk_no", sparse_vector(F.col("chunk"), dim).alias("v")))


def keyword_hits(cut: DataFrame, roles: DataFrame, small: bool) -> DataFrame:
    """`doc_key` and `hits`, a map from skill to its keywords found in any segment, both by their place.

    Keywords are looked for in the segment's own row.
    """
    asked = with_role(cut.select(DOC_KEY, "target_role", F.lower("text").alias("lower_text")), roles.select("role", F.transform(
        "skills", lambda s: F.struct(s.skill_ord.alias("skill_ord"), s.probes.alias("probes"))).alias("skills")), small)
    places = F.flatten(F.transform("skills", lambda s: F.filter(
        F.transform(s.probes, lambda p, i: F.when(found(F.col("lower_text"), p), F.struct(s.skill_ord.alias("skill_ord"), i.alias("kw_ord")))),
        lambda x: x.isNotNull(),
    )))
    rows = asked.select(DOC_KEY, F.inline(places)).groupBy(DOC_KEY, "skill_ord").agg(F.collect_set("kw_ord").alias("kw_ords"))
    return rows.groupBy(DOC_KEY).agg(F.map_from_entries(F.collect_list(F.struct("skill_ord", "kw_ords"))).alias("hits"))


def document_similarities(cut: DataFrame, roles: DataFrame, semantic: Semantic, small: bool) -> DataFrame:
    """`doc_key` and `similar`, a map from skill (by place) to the mean of its two best chunks.

    A chunk meets the skills of its role in one row. Counts are never negative, so a pair that
    shares no bucket has similarity 0 and makes no row; it is not in the map.
    """
    vectors = stored(chunk_vectors(cut, semantic.chunk_size, semantic.dim), "chunk-vectors")
    asked = with_role(vectors, roles.select("role", "wanted", F.transform(
        "skills", lambda s: F.struct(s.skill_ord.alias("skill_ord"), s.counts.alias("counts"), s.query_norm.alias("query_norm"))).alias("skills")), small)
    relevant = asked.select(DOC_KEY, "chunk_no", "skills", only_buckets(F.col("v"), F.col("wanted")).alias("v")).where(F.size("v.buckets") > 0)
    pairs = F.filter(F.transform("skills", lambda s: F.struct(
        s.skill_ord.alias("skill"), sparse_cosine(s.counts, s.query_norm, F.col("v")).alias("similarity"))), lambda p: p.similarity > 0)
    best = best_chunks(relevant.select(DOC_KEY, "chunk_no", F.inline(pairs)), found_only=True)
    n_chunks = vectors.groupBy(DOC_KEY).agg(F.count(F.lit(1)).alias("n_chunks"))
    totals = best.groupBy(DOC_KEY).agg(F.collect_list(F.struct("skill", "total")).alias("totals")).join(n_chunks, DOC_KEY)
    mean = F.transform("totals", lambda t: F.struct(t.skill.alias("key"), (t.total / F.least(F.lit(2), F.col("n_chunks")).cast("double")).alias("value")))
    return totals.select(DOC_KEY, F.map_from_entries(mean).alias("similar"))


def _scored_pieces(cut: DataFrame, roles: DataFrame, semantic: Semantic, similarities: DataFrame | None, small: bool) -> DataFrame:
    names = document_columns(cut)
    rows = with_role(cut.select(*names).distinct(), roles, small).join(keyword_hits(cut, roles, small), DOC_KEY, "left")
    if similarities is not None:
        rows = join_documents(rows, similarities)
        similarity = lambda s: F.try_element_at("similarities", s.skill)
    elif semantic.provider == "hashed":
        rows = rows.join(document_similarities(cut, roles, semantic, small), DOC_KEY, "left")
        similarity = lambda s: F.try_element_at("similar", s.skill_ord)
    else:
        similarity = lambda s: F.lit(0.0)

    def entry(s: Column) -> Column:
        own = F.try_element_at("hits", s.skill_ord)
        flags = F.transform(s.probes, lambda p, i: F.struct(p.keyword.alias("keyword"), F.coalesce(F.array_contains(own, i), F.lit(False)).alias("hit")))
        return F.struct(
            s.skill_ord.alias("skill_ord"), s.skill.alias("skill"), s.weight.alias("weight"), F.size(s.probes).alias("n_keywords"),
            F.coalesce(similarity(s), F.lit(0.0)).alias("similarity"), flagged(flags, True).alias("matched"), flagged(flags, False).alias("missing"),
        )

    evidence = rows.select(*names, "part", F.transform("skills", entry).alias("evidence"))
    return evidence.select(*names, "part", finished(F.col("evidence"), semantic).alias("skills"))


def score_rows(
    segments: DataFrame, role_skills: DataFrame, semantic: Semantic, similarities: DataFrame | None = None, small: bool = False
) -> DataFrame:
    """One row per document and skill: `doc_key, resume_id, role` and the columns of the row-local `skill_rows`.

    `small` tells whether the role table may be broadcast.
    """
    cut = prepared(segments, pieces_only=True)
    roles = stored(role_rows(role_skills, semantic, ROLE_PART), "roles")
    scored = score_skills(cut.where("whole"), roles, semantic, similarities, small)
    pieces = cut.where(~F.col("whole"))
    if not pieces.isEmpty():
        scored = scored.unionByName(_scored_pieces(pieces, roles, semantic, similarities, small))
    return skill_rows(scored)
