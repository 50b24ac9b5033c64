"""Document fingerprints by locally consistent parsing.

A text is cut into phrases again and again. At each level every symbol is compared with its left
neighbour, and the place and value of the lowest differing bit become its label (deterministic coin
tossing); four rounds leave six labels. A phrase begins where a label is a local maximum, so a cut
depends on five symbols to the left and one to the right, and equal substrings are cut alike
wherever they stand, but for their ends. A phrase is named by a hash of its symbols; the names are
the symbols of the next level. A run of one symbol stays in one phrase.

The fingerprint holds, for levels 2 to 4 (phrases of about 8, 25 and 80 characters), the smallest
hashes of the distinct names. The likeness of two fingerprints is the mean over the levels of the
estimated share of common names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.llm.shared import fresh, kind, table

LEVELS = (2, 3, 4)
SKETCH = 32
#: Code points parsed together; bounds memory except for one longer text.
BATCH_POINTS = 60_000

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


#: Hashes of the code points that most texts are made of.
POINT_NAMES = mixed(np.arange(1 << 14, dtype=np.uint64))


def toss(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One round: twice the place of the lowest bit that differs from the left neighbour, plus its value.

    Equal neighbours get twice the width of the type. The first symbol of a text keeps its low bit.
    """
    one = symbols.dtype.type(1)
    own = symbols[1:]
    low = own ^ symbols[:-1]
    low &= np.negative(low)
    out = np.empty(len(symbols), dtype=np.uint8)
    rest = out[1:]
    np.not_equal(own & low, 0, out=rest.view(bool))
    low -= one
    place = np.bitwise_count(low)
    place <<= 1
    rest += place
    out[starts] = (symbols[starts] & one).astype(np.uint8)
    return out


def next_level(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of texts laid end to end, and where each text then begins. No text is empty.

    Inside a run of one symbol, or of one phrase at the level below, no label is a local maximum:
    the run stays in one phrase.
    """
    label = symbols
    for _ in range(4):
        label = toss(label, starts)
    cut = np.zeros(len(symbols), dtype=bool)
    if len(symbols) > 2:
        up = label[1:] > label[:-1]
        np.greater(up[:-1], up[1:], out=cut[1:-1])
    cut[starts[1:] - 1] = False  # what follows the last symbol of a text is another text
    cut[starts] = True
    begins = np.flatnonzero(cut)
    lengths = np.diff(begins, append=len(symbols))
    place = np.arange(len(symbols), dtype=np.int64)
    place -= np.repeat(begins, lengths)
    place &= 63
    terms = POINT_NAMES[symbols] if symbols.dtype == np.uint32 and symbols.max() < len(POINT_NAMES) else mixed(symbols.astype(np.uint64))
    terms *= POWERS[place]
    sums = np.cumsum(terms)
    names = sums[begins + lengths - 1]
    names[1:] -= sums[begins[1:] - 1]
    return mixed(names), np.searchsorted(begins, starts)


def sketches(texts: list[np.ndarray], levels: tuple[int, ...] = LEVELS, size: int = SKETCH) -> list[list[np.ndarray]]:
    """For each text (code points) the smallest name hashes of each level; none for an empty text."""
    lengths = np.array([len(t) for t in texts])
    full = np.flatnonzero(lengths)
    out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.uint32) for _ in levels] for _ in texts]
    if not len(full):
        return out
    symbols = np.concatenate([texts[i] for i in full])
    starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
    for level in range(1, max(levels) + 1):
        symbols, starts = next_level(symbols, starts)
        if level in levels:
            k = levels.index(level)
            short = (symbols >> np.uint64(32)).astype(np.uint32)
            ends = np.append(starts[1:], len(short))
            for i, a, b in zip(full.tolist(), starts.tolist(), ends.tolist(), strict=True):
                out[i][k] = smallest(short[a:b], size)
    return out


def smallest(values: np.ndarray, size: int) -> np.ndarray:
    values = np.sort(values)
    if len(values) > 1:
        values = values[np.concatenate([[True], values[1:] != values[:-1]])]
    return values[:size]


def written(levels: list[np.ndarray]) -> str:
    return ":".join(x.astype(">u4").tobytes().hex() for x in levels)


def read(fingerprint: str) -> list[np.ndarray]:
    return [np.frombuffer(bytes.fromhex(x), dtype=">u4").astype(np.uint32) for x in fingerprint.split(":")]


def likeness(one: list[np.ndarray], other: list[np.ndarray], size: int = SKETCH) -> float:
    """Mean share of common names among the smallest of both; two empty texts are alike."""
    total = 0.0
    for a, b in zip(one, other, strict=True):
        if len(a) == 0 and len(b) == 0:
            total += 1.0
        elif len(a) and len(b):
            both = np.sort(np.concatenate([a, b]))
            twice = np.concatenate([both[1:] == both[:-1], [False]])
            distinct = np.concatenate([[True], both[1:] != both[:-1]])
            total += float(twice[distinct][:size].sum()) / min(size, int(distinct.sum()))
    return total / len(one)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and `fingerprint`. Null counts as empty; an empty text has no names at any level."""
    body, name = fresh(keep, "body", "fingerprint")
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for group in grouped((v.as_py() for v in batch.column(len(keep))), len):
                found += [written(x) for x in sketches([points(t) for t in group])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string())], names=[*keep, name])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kind(docs, c)}" for c in keep), f"`{name}` string"]))


def grouped(items: Iterator, size) -> Iterator[list]:
    """Consecutive items with about BATCH_POINTS code points in all."""
    group, total = [], 0
    for item in items:
        group.append(item)
        total += size(item)
        if total >= BATCH_POINTS:
            yield group
            group, total = [], 0
    if group:
        yield group


def block_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below the key, by binary search; 0 for null."""
    steps = len(bounds).bit_length()
    values = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(steps))]).cast("array<int>")
    reached = lambda at, w: F.coalesce(key >= F.get(values, at + w - 1), F.lit(False))
    return F.aggregate(widths, F.lit(0), lambda at, w: at + F.when(reached(at, w), w).otherwise(0))


def with_successors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (block, copied, key, body), sorted: each row not copied is followed by its successor.

    The successor is the next row of the whole table by key, of the last row the first one. Blocks
    are ranges of an integer key, four for each task; what reaches the driver is one bound and one
    first key a block. Only the first rows are copied, to the end of the block before, so the text
    moves once. Rows of one key are put in the order of their texts; null keys come first.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = 4 * tasks
    keys = docs.select(F.col(key).cast("long").alias("key"))
    cuts = keys.approxQuantile("key", [i / blocks for i in range(1, blocks)], 0.25 / blocks)
    block = block_of(F.col("key"), sorted({int(c) for c in cuts}))
    low = F.min(F.struct(F.col("key").isNotNull().alias("known"), "key"))["key"]
    firsts = keys.groupBy(block.alias("block")).agg(low.alias("key")).orderBy("block").collect()
    first: list[int | None] = [None] * blocks
    before = [0] * blocks
    for i, row in enumerate(firsts):
        first[row["block"]], before[row["block"]] = row["key"], firsts[i - 1]["block"]
    listed = lambda values, k: F.array(*[F.lit(v) for v in values]).cast(f"array<{k}>")
    own = F.struct(F.col("at").alias("block"), F.lit(False).alias("copied"))
    copy = F.struct(F.get(listed(before, "int"), F.col("at")).alias("block"), F.lit(True).alias("copied"))
    is_first = F.col("key").eqNullSafe(F.get(listed(first, "bigint"), F.col("at")))
    return (
        docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
        .withColumn("at", block)
        .select(F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))).alias("goes"), "key", "body")
        .select("goes.block", "goes.copied", "key", "body")
        .repartition(tasks, "block")
        .sortWithinPartitions("block", "copied", "key", "body")
    )


def edited(text: str, following: str) -> str:
    """The last half replaced by as many first code points of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDIT_SCHEMA = (
    "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def compare_with_edits(rows: DataFrame) -> DataFrame:
    """Fingerprints of texts, of their edits with the successor, and likenesses; rows as above."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        waiting = None
        for batch in batches:
            for block, copied, key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and waiting[0] == block:
                    yield waiting[1], waiting[2], body
                waiting = None if copied else (block, key, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(pairs(batches), lambda x: 2 * len(x[1])):
            changed = [edited(t, following) for _, t, following in group]
            parsed = sketches([points(t) for t in [*(x[1] for x in group), group[-1][2], *changed]])
            n = len(group)
            names = [written(x) for x in parsed]
            out = {
                "key": [x[0] for x in group], "n_chars": [len(x[1]) for x in group],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                "fingerprint": names[:n], "edited_fingerprint": names[n + 1 :],
                "near_edited": [likeness(parsed[i], parsed[n + 1 + i]) for i in range(n)],
                # a group breaks inside a chain of successors only after its last row
                "near_next": [likeness(parsed[i], parsed[i + 1] if i + 1 == n or group[i + 1][1] is group[i][2] else sketches([points(group[i][2])])[0]) for i in range(n)],
            }
            yield pa.RecordBatch.from_pydict(out, schema=EDIT_ARROW)

    return rows.mapInArrow(run, EDIT_SCHEMA)


EDIT_ARROW = pa.schema([
    ("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = with_successors(table(spark, sf_dir, "documents"), "doc_id", "text")
    return compare_with_edits(rows).withColumnRenamed("key", "doc_id")
