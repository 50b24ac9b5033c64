"""Quality rules whose limits come from the data: histograms per language and source, merged upwards.

Each measure is a whole number, and its values are counted in buckets that are exact when small and
within a thirty-second of the value when large. Such a histogram is a quantile sketch that merges by
adding counts: tasks, sources and languages alike. A document is judged by the fences its own source
and language, or where these are few, its language or the whole table, give each measure. All of it
is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolemeter.functions.core import let
from rolemeter.llm.shared import fresh, table
from rolemeter.operators.dimensions import lookup_join
from rolemeter.operators.layout import stored

WHITESPACE = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Buckets keep so many leading bits of a value.
BITS = 6
#: A group with fewer documents is judged by the next larger one.
MIN_GROUP = 200
#: How far beyond the quartiles a fence lies, in quartile distances.
REACH = 3

#: Each measure, in thousandths: its name, whether small values are odd too, and the least room beyond a quartile.
MEASURES = (("word_length", True, 1500), ("symbol_share", False, 100), ("line_share", False, 500))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of eight words that occur more than once in the array.

    Windows are compared by 64-bit hashes, put together from those of their halves. Only where two are equal are they sorted and the
    places of those with a neighbour of equal hash put in order; each then adds the words that
    the place before has not covered.
    """

    def covered(hashes: Column) -> Column:
        sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(pairs: Column) -> Column:
            several = F.filter(
                F.transform(pairs, lambda p, k: F.when((F.get(pairs, k - 1).h == p.h) | (F.get(pairs, k + 1).h == p.h), p.i)), lambda i: i.isNotNull(),
            )
            return let(F.sort_array(several), lambda places: F.aggregate(
                F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(p - F.get(places, k - 1), F.lit(WINDOW)))),
                F.lit(0).cast("long"), lambda n, x: n + x,
            ))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(sorted_, of))

    def doubled(hashes: Column, width: int) -> Column:
        """Hashes of twice as wide windows."""
        n = F.greatest(F.size(hashes) - width, F.lit(0))
        return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h1: let(doubled(h1, 1), lambda h2: let(doubled(h2, 2), lambda h4: let(doubled(h4, 4), covered))))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with `n_words`, `word_chars`, `n_symbols`, `n_lines`, `n_dup_lines` and `n_repeat_words`, without their text.

    A null text is empty and has none of anything. A line counts if it has a word; it is a duplicate if an
    earlier line of the text is equal, white space included.
    """
    rest = [c for c in docs.columns if c != text]
    names = fresh(rest, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "words", "lines", "body")
    *counts, words, lines, body = names
    texts = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias(body))
    # generators keep the arrays from being computed for each use
    trimmed = F.btrim(F.col(body), F.lit(WHITESPACE))
    cut = F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))
    whole = F.filter(F.split(F.col(body), "\n"), lambda line: F.btrim(line, F.lit(WHITESPACE)) != "")
    arrays = texts.select(*rest, F.inline(F.array(F.struct(
        cut.alias(words), whole.alias(lines), F.regexp_count(F.col(body), F.lit(SYMBOLS)).cast("long").alias(names[2]),
    ))))
    n_words, n_lines = F.size(words).cast("long"), F.size(lines).cast("long")
    return arrays.select(
        *rest, n_words.alias(counts[0]), F.length(F.array_join(words, "")).cast("long").alias(counts[1]), F.col(names[2]), n_lines.alias(counts[3]),
        (n_lines - F.size(F.array_distinct(lines))).alias(counts[4]), repeated_words(F.col(words)).cast("long").alias(counts[5]),
    )


def _shares() -> dict[str, Column]:
    """The measures, null where a document has nothing to divide by: characters a word, symbols a word, duplicate lines a line."""
    per = lambda a, b: F.when(F.col(b) > 0, F.expr(f"(1000 * {a}) div {b}"))
    return {"word_length": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "n_words"), "line_share": per("n_dup_lines", "n_lines")}


def bucket(value: Column) -> Column:
    """The least value of the bucket a whole number falls into: its BITS leading bits, the others 0."""
    extra = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, extra), extra)


def histograms(rows: DataFrame) -> DataFrame:
    """`lang, source, measure, bucket, n`: the sketch of every measure for each language and source; `rows` has the measures."""
    entries = F.array(*[F.struct(F.lit(name).alias("measure"), bucket(F.col(name)).alias("bucket")) for name, _, _ in MEASURES])
    return rows.select("lang", "source", F.inline(entries)).where(F.col("bucket").isNotNull()).groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches put together by `keys`, as `group, measure, bucket, n`. A null key is a key like any other."""
    group = F.to_json(F.struct(*keys)) if keys else F.lit("{}")  # as JSON, null and the empty string differ
    return sketches.groupBy(group.alias("group"), "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """`group` with `group_size` and `limits`, a map from measure to (low, high).

    The quartiles of a sketch are the least buckets with a quarter and three quarters of the values
    at or below them; a fence is REACH times their distance beyond, or the measure's least room.
    """
    of = Window.partitionBy("group", "measure")
    counted = sketches.withColumn("below", F.sum("n").over(of.orderBy("bucket"))).withColumn("total", F.sum("n").over(of))
    quartile = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("total"), F.col("bucket")))
    room = F.create_map(*[F.lit(x) for name, _, least in MEASURES for x in (name, least)])[F.col("measure")]
    both = F.col("measure").isin([name for name, small, _ in MEASURES if small])
    beyond = F.greatest(REACH * (F.col("third") - F.col("first")), room.cast("long"))
    return (
        counted.groupBy("group", "measure").agg(F.max("total").alias("total"), quartile(1).alias("first"), quartile(3).alias("third"))
        .withColumn("limit", F.struct(F.when(both, F.col("first") - beyond).alias("low"), (F.col("third") + beyond).alias("high")))
        .groupBy("group").agg(F.max("total").alias("group_size"), F.map_from_entries(F.collect_list(F.struct("measure", "limit"))).alias("limits"))
    )


def limits_of_groups(rows: DataFrame) -> DataFrame:
    """`lang_source` to `level` (source, lang or all) and `limits`, for every language and source of `rows`.

    Groups of fewer than MIN_GROUP documents that pass the base rules take the limits of their
    language, or if that has as few, those of the whole table; none at all if no document passes.
    """
    sketches = stored(histograms(rows.where(~F.col("base_failed"))), "sketches")
    by_source, by_lang, by_all = (fences(merged(sketches, keys)) for keys in (["lang", "source"], ["lang"], []))
    groups = rows.select("lang", "source").distinct().select(
        F.to_json(F.struct("lang", "source")).alias("lang_source"), F.to_json(F.struct("lang")).alias("of_lang"), F.lit("{}").alias("of_all"),
    )
    named = lambda table_, key, prefix: table_.select(F.col("group").alias(key), F.col("group_size").alias(f"{prefix}_size"), F.col("limits").alias(prefix))
    joined = groups.join(named(by_source, "lang_source", "source"), "lang_source", "left")
    joined = lookup_join(joined, named(by_lang, "of_lang", "lang"), "of_lang", "left", spread_by="lang_source")
    joined = lookup_join(joined, named(by_all, "of_all", "all"), "of_all", "left", small=True)  # one row
    own, larger = F.col("source_size") >= MIN_GROUP, F.col("lang_size") >= MIN_GROUP
    return joined.select(
        "lang_source", F.when(own, F.lit("source")).when(larger, F.lit("lang")).otherwise(F.lit("all")).alias("level"),
        F.when(own, F.col("source")).when(larger, F.col("lang")).otherwise(F.col("all")).alias("limits"),
    )


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row a document: `key`, `lang`, `source`, the counts of `measured`, the measures, `base_failed`, `level`, `outside`, `kept`.

    Empty and null texts fail the base rules for want of words. A null language or source is a
    group of its own, repeated rows count as often as they come, and an empty table gives no rows.
    `outside` names the measures beyond the fences of the document's group; a value on a fence is inside.
    """
    named = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = stored(measured(named).select("*", *[c.alias(name) for name, c in _shares().items()], failed.alias("base_failed")), "quality")
    limits = stored(limits_of_groups(rows), "limits")
    keyed = rows.withColumn("lang_source", F.to_json(F.struct("lang", "source")))
    joined = lookup_join(keyed, limits, "lang_source", "left", spread_by="key")

    def beyond(name: str) -> Column:
        limit = F.try_element_at("limits", F.lit(name))
        return F.when((F.col(name) < limit["low"]) | (F.col(name) > limit["high"]), F.lit(name))

    outside = F.concat_ws(",", *[beyond(name) for name, _, _ in MEASURES])
    return joined.select(*rows.columns, "level", outside.alias("outside")).withColumn("kept", ~F.col("base_failed") & (F.col("outside") == ""))


def filtered(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents that stay, with the columns they had; rows alike in id, language, source and text share a verdict."""
    (name,) = fresh(docs.columns, "own_key")
    own = F.concat(F.to_json(F.struct(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(source).alias("s"))), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    keyed = docs.withColumn(name, own)
    gone = judged(keyed, text, lang, source, name).where(~F.col("kept")).select(F.col("key").alias(name)).distinct()
    return lookup_join(keyed, gone, name, "left_anti", spread_by=name).select(*docs.columns)


def op13_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs).select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level", "outside",
    )


def _sql_group(keys: str) -> str:
    return f"""
  SELECT {keys}measure, max(total) AS total, min(CASE WHEN 4 * below >= total THEN bucket END) AS q1, min(CASE WHEN 4 * below >= 3 * total THEN bucket END) AS q3 FROM (
    SELECT {keys}measure, bucket, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {keys}measure) AS total
    FROM (SELECT {keys}measure, bucket, sum(n) AS n FROM hist GROUP BY ALL)) GROUP BY ALL"""


_ROOM = " ".join(f"WHEN '{name}' THEN {least}" for name, _, least in MEASURES)
_SMALL = ", ".join(f"'{name}'" for name, small, _ in MEASURES if small)
_ORDER = " ".join(f"WHEN '{name}' THEN {k}" for k, (name, _, _) in enumerate(MEASURES))

OP13_SQL = rf"""
WITH cut AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^ 	-
]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM cut)
), several AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM several) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM cut LEFT JOIN repeated USING (doc_id)
), shared AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words END AS word_length, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words END AS symbol_share,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS line_share FROM counts
), long AS (
  SELECT doc_id, coalesce(lang, chr(1)) AS l, coalesce(source, chr(1)) AS s, base_failed, measure, v,
    (v >> greatest(length(bin(v)) - {BITS}, 0)::INT) << greatest(length(bin(v)) - {BITS}, 0)::INT AS bucket
  FROM (SELECT doc_id, lang, source, base_failed, unnest(['word_length', 'symbol_share', 'line_share']) AS measure, unnest([word_length, symbol_share, line_share]) AS v FROM shared)
), hist AS (SELECT l, s, measure, bucket, count(*) AS n FROM long WHERE NOT base_failed AND v IS NOT NULL GROUP BY ALL),
g2 AS ({_sql_group("l, s, ")}), g1 AS ({_sql_group("l, ")}), g0 AS ({_sql_group("")}),
size2 AS (SELECT l, s, max(total) AS total FROM g2 GROUP BY ALL), size1 AS (SELECT l, max(total) AS total FROM g1 GROUP BY ALL),
leveled AS (
  SELECT long.*, CASE WHEN size2.total >= {MIN_GROUP} THEN 'source' WHEN size1.total >= {MIN_GROUP} THEN 'lang' ELSE 'all' END AS level
  FROM long LEFT JOIN size2 USING (l, s) LEFT JOIN size1 USING (l)
), limited AS (
  SELECT x.doc_id, x.level, x.measure, x.v, CASE x.level WHEN 'source' THEN g2.q1 WHEN 'lang' THEN g1.q1 ELSE g0.q1 END AS q1,
    CASE x.level WHEN 'source' THEN g2.q3 WHEN 'lang' THEN g1.q3 ELSE g0.q3 END AS q3
  FROM leveled x LEFT JOIN g2 ON x.l = g2.l AND x.s = g2.s AND x.measure = g2.measure LEFT JOIN g1 ON x.l = g1.l AND x.measure = g1.measure LEFT JOIN g0 ON x.measure = g0.measure
), verdict AS (
  SELECT doc_id, any_value(level) AS level, coalesce(string_agg(measure, ',' ORDER BY CASE measure {_ORDER} END) FILTER (
    WHERE v > q3 + greatest({REACH} * (q3 - q1), CASE measure {_ROOM} END) OR (measure IN ({_SMALL}) AND v < q1 - greatest({REACH} * (q3 - q1), CASE measure {_ROOM} END))), '') AS outside
  FROM limited GROUP BY doc_id
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND outside = '' AS kept, level, outside
FROM shared JOIN verdict USING (doc_id)
"""
