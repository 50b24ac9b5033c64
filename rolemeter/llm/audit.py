"""Which filters remove what, in every order: an audit of filters over a sparse document-term matrix.

Words get numbers that hold for the whole table: every task numbers the words of its own shard, the
shards' distinct words are numbered globally, and each shard's numbers are replaced by the global
ones. A shard is a CSR matrix, a row a document; the sums and the nonzero counts of its rows are the
words and the distinct words of a document. With the other filters' flags a document is then one of
32 masks, and counts by part and mask answer for all 120 orders of the filters.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolemeter.llm.shared import fresh, kind, slices, table
from rolemeter.operators.dimensions import lookup_join
from rolemeter.operators.layout import stored

#: A shard is made of at most so many bytes of text, or of one longer text.
SHARD_BYTES = 1 << 22
#: So many places of words are put together by shard before a task gives them on.
PLACES = 1 << 20

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
#: Bytes that begin no code point of UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))


class Feature(NamedTuple):
    """A column computed from the UTF-8 bytes of a text in the pass that cuts it into words."""

    name: str
    kind: str
    arrow: pa.DataType
    of: Callable[[bytes], object]


def encoded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """The texts as a CSR matrix of their own: row ends, word numbers, counts, and the words by number."""
    pieces = pc.ascii_split_whitespace(texts)  # cut at the six ASCII whitespace characters
    ends, words = pieces.offsets.to_numpy(), pieces.flatten()
    filled = pc.not_equal(pc.binary_length(words), 0)  # space at an end of a text gives an empty piece
    numbered = words.filter(filled).dictionary_encode()
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(ends))[filled.to_numpy(zero_copy_only=False)]
    keys = np.sort(row << 32 | numbered.indices.to_numpy())
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    entries = keys[starts]
    return np.searchsorted(entries >> 32, np.arange(len(texts) + 1)), entries & 0xFFFFFFFF, np.diff(np.append(starts, len(keys))), numbered.dictionary


def one_list(values: pa.Array) -> pa.Array:
    """The values as the one row of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def packed(numbers: np.ndarray, to: type) -> pa.Array:
    """The numbers as the one row of a binary column, little-endian."""
    return pa.array([numbers.astype(np.dtype(to).newbyteorder("<")).tobytes()], pa.binary())


def unpacked(column: pa.Array, of: type) -> np.ndarray:
    return np.frombuffer(column[0].as_py(), dtype=np.dtype(of).newbyteorder("<"))


def planes(numbers: np.ndarray) -> pa.Array:
    """The numbers as the one row of a binary column: the lowest bytes of all, then the next ones, as high bytes are mostly zero and compress."""
    return pa.array([numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary())


def from_planes(value: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(value, dtype=np.uint8).reshape(4, -1).T).view("<i4").ravel()


def steps(numbers: np.ndarray, base: int) -> np.ndarray:
    """Growing numbers as the step from each to the next, the first from the base."""
    return np.diff(numbers, prepend=base)


def packed_counts(counts: np.ndarray) -> pa.Array:
    """Counts in 8 bits if all fit, else 32."""
    return packed(counts, np.uint8 if not len(counts) or counts.max() < 256 else np.int32)


def unpacked_counts(column: pa.Array, entries: int) -> np.ndarray:
    return unpacked(column, np.uint8 if len(column[0].as_py()) == entries else np.int32)


def local_shards(docs: DataFrame, text: str, keep: tuple[str, ...], features: tuple[Feature, ...] = ()) -> DataFrame:
    """CSR shards whose columns are numbers of the shard's own `words`; one pass over the texts.

    `shard`, an array for each kept column and each feature, packed `indptr`, `codes` (in planes) and `counts`, and `words`. Words are runs of characters other than ASCII whitespace, case kept. A null text has none.
    """
    (body,) = fresh(keep, "body")
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(body))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin, size in slices(batch.column(width), SHARD_BYTES):
                part = batch.slice(begin, size)
                texts = part.column(width)
                made = [pa.array([f.of(t.as_py()) for t in texts.cast(pa.binary())], f.arrow) for f in features]
                indptr, codes, counts, words = encoded(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), *(one_list(a) for a in (*part.columns[:width], *made)),
                        packed(indptr, np.int32), planes(codes), packed_counts(counts), one_list(words.cast(pa.binary())),
                    ], names=names,
                )
                number += 1

    kept = [*keep, *(f.name for f in features)]
    names = [*fresh(kept, "shard"), *kept, *fresh([*kept, "shard"], "indptr", "codes", "counts", "words")]
    kinds = ["bigint", *(f"array<{kind(docs, c)}>" for c in keep), *(f"array<{f.kind}>" for f in features), "binary", "binary", "binary", "array<binary>"]
    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def _word_numbers(shards: DataFrame, shard: str, words: str) -> tuple[DataFrame, DataFrame]:
    """The global numbers of every shard's words, and the dictionary (`word`, `id`).

    The words of all shards are dealt by word and sorted, by hash first as that compares fast, so one pass
    numbers the distinct words of a partition; the partitions' sizes, a row each, then make the
    numbers global. What a partition has for a shard is one row or a few, `shard`, `start`, `codes` and
    `numbers` (as steps, the first from `start`), so what goes back to the shards is not a row a word.
    """
    listed = shards.select(F.col(shard).alias("shard"), F.posexplode(words).alias("code", "word"))
    dealt = listed.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word").sortWithinPartitions(F.xxhash64("word"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, last, held, rows = TaskContext.get().partitionId(), -1, None, [], 0

        def out() -> pa.RecordBatch:
            of, codes, numbers, new = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(of, kind="stable")
            firsts = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0]))
            groups = np.split(order, firsts[1:])
            base, reached = int(numbers[0]), int(numbers[-1]) + 1  # numbers only grow; PLACES of them fit 32 bits
            columns = [
                [planes(codes[g])[0] for g in groups], [planes(steps(numbers[g], base))[0] for g in groups],
                [packed(np.packbits(new[g]), np.uint8)[0] for g in groups],
            ]
            same = [pa.array(np.full(len(groups), x)) for x in (part, base, reached)]
            return pa.RecordBatch.from_arrays([pa.array(of[order][firsts]), *same, *(pa.array(c, pa.binary()) for c in columns)], names=names)

        for batch in batches:
            if not len(batch):
                continue
            column = batch.column(2)
            new = np.concatenate([[column[0].as_py() != last], pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)])
            numbers = number + np.cumsum(new)
            number, last = int(numbers[-1]), column[-1].as_py()
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), numbers, new))
            rows += len(batch)
            if rows >= PLACES:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    names = ["shard", "part", "base", "reached", "codes", "numbers", "new"]
    placed = stored(dealt.mapInArrow(run, "shard bigint, part bigint, base bigint, reached bigint, codes binary, numbers binary, new binary"), "words")
    sizes = placed.groupBy("part").agg(F.max("reached").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = placed.join(F.broadcast(starts), "part").withColumn("start", F.col("start") + F.col("base"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                codes, numbers = from_planes(row.column(2)[0].as_py()), np.cumsum(from_planes(row.column(3)[0].as_py()), dtype=np.int64)
                new = np.unpackbits(unpacked(row.column(4), np.uint8), count=len(codes)) > 0
                codes, numbers = codes[new], numbers[new]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row.column(0)[0].as_py())), pa.array(codes), pa.array(numbers + row.column(1)[0].as_py())], names=["shard", "code", "id"])

    first = numbered.select("shard", "start", "codes", "numbers", "new").mapInArrow(entries, "shard bigint, code int, id bigint")
    named = listed.join(first, ["shard", "code"])
    return numbered.select("shard", "start", "codes", "numbers"), named.select(F.col("word").cast("string").alias("word"), "id")


def term_matrix(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), features: tuple[Feature, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix as CSR shards, and its dictionary (`word`, `id`).

    A shard has `shard`, an array for each kept column and feature with the rows' values, and packed
    little-endian `indptr` (32 bits), `indices` (64 bits; global ids, dense from 0) and `data`
    (counts, in 8 bits if all of the shard fit, else 32). Documents are not cut, so a shard holds
    SHARD_BYTES of text or one longer document. What is shuffled to number the words is a
    row for each distinct word of a shard; a frequent word has a row a shard, a few bytes each, and
    what goes back is a row or a few for each shard and partition.
    Repeated rows are rows of their own; an empty table gives no shards and no words.
    """
    shards = stored(local_shards(docs, text, keep, features), "shards")
    shard, *kept, indptr, codes, counts, words = shards.columns
    numbers, dictionary = _word_numbers(shards, shard, words)
    ids = numbers.groupBy("shard").agg(F.collect_list(F.struct("start", "codes", "numbers")).alias("ids"))
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                local = from_planes(row.column(width + 2)[0].as_py())
                found = np.zeros(int(local.max()) + 1 if len(local) else 0, dtype=np.int64)
                for piece in row.column(width + 4)[0].as_py() or ():
                    found[from_planes(piece["codes"])] = np.cumsum(from_planes(piece["numbers"]), dtype=np.int64) + piece["start"]
                indices = packed(found[local], np.int64)
                yield pa.RecordBatch.from_arrays([*row.columns[: width + 2], indices, row.column(width + 3)], names=names)

    names = [shard, *kept, *fresh([shard, *kept], "indptr", "indices", "data")]
    kinds = ["bigint", *(kind(shards, c) for c in kept), "binary", "binary", "binary"]
    joined = shards.join(ids.withColumnRenamed("shard", shard), shard, "left").select(shard, *kept, indptr, codes, counts, "ids")
    return joined.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))), dictionary


def row_counts(matrix: DataFrame) -> DataFrame:
    """One row a document: the kept columns, `n_words` (its row's sum) and `n_distinct` (its nonzero entries)."""
    keep = matrix.columns[1:-3]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                ends = unpacked(row.column(width + 1), np.int32)
                sums = np.concatenate([[0], np.cumsum(unpacked_counts(row.column(width + 3), int(ends[-1])), dtype=np.int64)])[ends]
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c).flatten() for c in range(1, width + 1)), pa.array(np.diff(sums)), pa.array(np.diff(ends).astype(np.int64))], names=names,
                )

    names = [*keep, *fresh(keep, "n_words", "n_distinct")]
    kinds = [*(matrix.schema[c].dataType.elementType.simpleString() for c in keep), "bigint", "bigint"]
    return matrix.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def many_capitals(data: bytes) -> bool:
    return 100 * (len(data) - len(data.translate(None, CAPITALS))) > MAX_CAPITAL_PERCENT * len(data.translate(None, CONTINUED))


FLAGS = (
    Feature("digest", "binary", pa.binary(), lambda data: hashlib.sha256(data).digest()),
    Feature("capitals", "boolean", pa.bool_(), many_capitals),
    Feature("signs", "boolean", pa.bool_(), lambda data: len(data.translate(None, SIGNS)) < len(data)),
)


def failures(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """Documents counted by `key`, `part`, `digest`, `n_words`, `n_distinct` and `mask`; bit k of the mask: they fail FILTERS[k].

    A null text is empty, a null part the empty string. A text is a copy (E) if an equal one has a
    smaller id; rows of one id are no copies of one another, and a null id is larger than any other.
    """
    named = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    matrix, _ = term_matrix(named, "text", ("key", "part"), FLAGS)
    rows = stored(row_counts(matrix), "audit-rows")
    copies = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    copied = F.coalesce(F.col("key") > F.col("first"), F.col("key").isNull() & F.col("first").isNotNull())
    flags = [
        F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"), F.col("capitals"), F.col("signs"), copied,
    ]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(flags)), F.lit(0))
    # repeated rows become one before the join
    counted = rows.groupBy("key", "part", "digest", "n_words", "n_distinct", "capitals", "signs").agg(F.count(F.lit(1)).alias("n"))
    joined = lookup_join(counted, copies, "digest", "left", spread_by="key")
    return joined.select("key", "part", "digest", "n_words", "n_distinct", mask.alias("mask"), "n")


def _orders() -> Column:
    """All orders of the filters, a struct for each step: the filter's bit and the bits before it."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        steps += [{"filter_order": name, "step": i + 1, "own": 1 << k, "earlier": sum(1 << x for x in order[:i])} for i, k in enumerate(order)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,earlier:int>>")


def interactions(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of filters and step: `kept`, `removed`, `redundant`, `unique_fails`, `good_lost`, `toxic_lost`, `shapley`.

    `failed` is what `failures` gives; `labels` has `doc_id`, `quality` and `toxic`. A label counts
    if any row of the id has it; documents without labels lose none. What is grouped by part is at
    most 32 masks. `shapley` sums the filter's removals over all orders: of a document that fails
    m filters each of these removes it in 120 / m orders.
    """
    marks = labels.groupBy(F.col("doc_id").alias("key")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"),
    ).where("good = 1 OR toxic = 1")
    masks = (
        failed.join(marks, "key", "left").groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )
    per_part = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = per_part.select("part", "masks", F.inline(_orders()))
    orders = 120

    def total(value: str, which) -> Column:
        chosen = F.filter("masks", which)
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda n, m: n + m[value])

    def fails(m: Column, bits: str) -> Column:
        return m["mask"].bitwiseAND(F.col(bits)) != 0

    def removed(m: Column) -> Column:
        return fails(m, "own") & ~fails(m, "earlier")

    share = F.aggregate(F.filter("masks", lambda m: fails(m, "own")), F.lit(0).cast("long"), lambda n, m: n + (m["n"] * F.lit(orders) / F.bit_count(m["mask"])).cast("long"))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m, "own") & ~fails(m, "earlier")).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m, "own") & fails(m, "earlier")).alias("redundant"), total("n", lambda m: m["mask"] == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return interactions(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


_MASK = "(a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT)"

OP11_SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), flags AS (
  SELECT doc_id, part, len(w) < {MIN_WORDS} AS a, 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) AS b,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITAL_PERCENT} * len(t) AS c, regexp_matches(t, '[{SIGNS.decode()}]') AS d,
    doc_id > min(doc_id) OVER (PARTITION BY t) AS e
  FROM words
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, {_MASK} AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id) GROUP BY ALL
), bits AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [p.letter, q.letter, r.letter, s.letter, t.letter] AS letters, [p.bit, q.bit, r.bit, s.bit, t.bit] AS own
  FROM bits p, bits q, bits r, bits s, bits t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5
), steps AS (
  SELECT array_to_string(letters, '') AS filter_order, k::INT AS step, own[k] AS own, coalesce(list_sum(own[1:k - 1]), 0)::INT AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
)
SELECT part, filter_order, step,
  sum(CASE WHEN mask & own = 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & own <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM masks, steps GROUP BY part, filter_order, step
"""
