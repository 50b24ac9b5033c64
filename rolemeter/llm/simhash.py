"""SimHash near-duplicates by tiled exact comparison.

Every text becomes a fingerprint; equal fingerprints are one node from then on. Nodes are dealt to
bands, and a band to tiles of bounded size. Two tiles are compared, with exclusive-or and bit counts
in numpy, only if their bands can hold a link:

* by population counts: the counts of bits in each 16-bit word of two fingerprints differ by at most
  the radius in all, so tiles whose counts differ by more are skipped;
* by size, where a least similarity is asked for: then the shingle counts have at least that ratio.

The pairs of tiles of two bands are dealt by shares of either band's tiles, so no task gets more than
about SHARE times SHARE pairs of two bands for one key, however many tiles a band has.

A pair of tiles gives no more links than it has nodes: those of a spanning forest, which connect
what all its links connect.

Where links are to be exact, fingerprints only give the candidates. Then a node is a set of shingles;
nodes that have a candidate are dealt anew, to tiles bounded by their shingles, which carry the sets.
Two nodes are joined only if the similarity of their sets suffices; pairs joined already are skipped.

Components are found by alternating star contraction over tables, with
checkpoints; no link, node or component ever goes to the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.llm.shared import checkpointed, fresh, kind, small_batches, table
from rolemeter.operators.dimensions import is_small

SEED = 42
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Nodes of a tile, about; and the most comparisons whose results are held at once.
TILE = 8192
AT_ONCE = 1 << 16
#: Shingles of a tile that carries sets, about; and the most sets compared with one at a time.
SET_TILE = 1 << 19
SETS_AT_ONCE = 64
#: Tiles of a band that are one share.
SHARE = 8
#: Bytes of texts or tiles that a task gets at once, unless one row has more.
SENT = 1 << 23
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14
WORD_BITS, WORDS = 16, 4


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words, repeats included; a shorter text is one shingle, an empty one none.

    Words are split at blanks and A-Z lowered, both on UTF-8.
    """
    found = text.encode().translate(LOWER_BYTES).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < words:
        found = [b" ".join(found)]
    elif words > 1:
        found = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, found, itertools.repeat(SEED)), dtype=np.uint64)


def fingerprint(hashes: np.ndarray, parts: int) -> list[int]:
    """Signed 64-bit parts; a bit is 1 if set in over half the hashes. Parts after the first rehash."""
    out = []
    for part in range(parts):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), BLOCK):
            h = hashes[at : at + BLOCK]
            if part:
                h = (h ^ np.uint64(part)) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            counts += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def set_id(hashes: np.ndarray) -> int:
    """A signed hash of a sorted set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def fingerprints(docs: DataFrame, text: str, key: str, words: int, parts: int, distinct: bool = False) -> DataFrame:
    """key, text_hash, size (shingles) and the parts f0, f1, ... of every row; null counts as empty.

    With `distinct` a repeated shingle counts once, and `set_id` tells sets of shingles apart.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).select("key", F.xxhash64("body").alias("text_hash"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, ids = [], [], []
            for value in batch.column(2):
                hashes = shingle_hashes(value.as_py(), words)
                if distinct:
                    hashes = np.unique(hashes)
                    ids.append(set_id(hashes))
                sizes.append(len(hashes))
                found.append(fingerprint(hashes, parts))
            columns = [pa.array([f[p] for f in found], pa.int64()) for p in range(parts)]
            if distinct:
                columns.append(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *columns], names=names)

    names = ["key", "text_hash", "size", *(f"f{p}" for p in range(parts)), *(["set_id"] if distinct else [])]
    return rows.mapInArrow(run, f"key {kind(docs, key)}, " + ", ".join(f"{n} bigint" for n in names[1:]))


def bands(nodes: DataFrame, parts: int, radius: int, ratio: float | None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The nodes with their `band`; and what gives tiles the bands `probe` they are compared with.

    A band is compared with itself and with those after it that can hold a link.
    """
    if ratio is not None:
        # a little wider than the ratio, so rounding never puts two linked sizes two bands apart
        step = -math.log(ratio * 0.999)
        band = F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / step)).otherwise(-2)
        return nodes.withColumn("band", band.cast("long")), lambda tiles: tiles.withColumn("probe", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    if parts > 1 or radius > 4:
        return nodes.withColumn("band", F.lit(0).cast("long")), lambda tiles: tiles.withColumn("probe", F.col("band"))
    base = WORD_BITS + 1
    counts = [F.bit_count(F.shiftrightunsigned(F.col("f0"), WORD_BITS * i).bitwiseAND(F.lit((1 << WORD_BITS) - 1))).cast("long") for i in range(WORDS)]
    band = sum(c * base**i for i, c in enumerate(counts))
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, d)) <= radius and d >= (0,) * WORDS]

    def probes(tiles: DataFrame) -> DataFrame:
        own = [F.floor(F.col("band") / F.lit(base**i)) % base for i in range(WORDS)]
        moved = [F.when(_within(own, d, base), F.col("band") + sum(x * base**i for i, x in enumerate(d))) for d in steps]
        return tiles.withColumn("probe", F.explode(F.array_compact(F.array(*moved))))

    return nodes.withColumn("band", band), probes


def _within(own: list, step: tuple[int, ...], base: int):
    ok = F.lit(True)
    for value, move in zip(own, step, strict=True):
        if move:
            ok = ok & (value + move >= 0) & (value + move < base)
    return ok


def joinable(small: DataFrame) -> DataFrame:
    """A table of a row a band, to be broadcast if it is small."""
    return F.broadcast(small) if is_small(small) else small


def tiles(nodes: DataFrame, fields: list[str], tile: int, sets: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (band, chunk, items): the nodes of a band in chunks of about `tile`, by a hash of the node; and (band, chunks).

    `items` holds the fields of each node end to end; with `sets` there is a column `sets` of their
    shingles, and `tile` counts shingles.
    """
    weight = F.sum("size") if sets else F.count(F.lit(1))
    chunks = checkpointed(nodes.groupBy("band").agg(F.greatest(F.ceil(weight / tile), F.lit(1)).cast("long").alias("chunks")))
    dealt = nodes.join(joinable(chunks), "band")
    dealt = dealt.select("band", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.struct(F.array(*fields).alias("item"), *(["set"] if sets else [])).alias("node"))
    made = dealt.groupBy("band", "chunk").agg(F.collect_list("node").alias("nodes"))
    return made.select("band", "chunk", F.flatten("nodes.item").alias("items"), *([F.col("nodes.set").alias("sets")] if sets else [])), chunks


def tile_pairs(made: DataFrame, chunks: DataFrame, probes: Callable[[DataFrame], DataFrame], held: list[str]) -> DataFrame:
    """Every tile (own, own_chunk, own_...) beside the tiles of the bands it probes, within its own band each pair once.

    A key is a band that is probed, a share of its tiles and a share of those that probe it. The
    number of partitions is given, as what a pair costs shows in no table's size.
    """
    asking = probes(chunks).groupBy("probe").agg(F.max("chunks").alias("most"))
    both = chunks.withColumnRenamed("band", "probe").join(asking, "probe")
    shares = joinable(checkpointed(both.select("probe", *[F.ceil(F.col(c) / SHARE).cast("long").alias(n) for c, n in (("chunks", "shares"), ("most", "own_shares"))])))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    left = probes(made).select("probe", F.col("band").alias("own"), F.col("chunk").alias("own_chunk"), *[F.col(c).alias(f"own_{c}") for c in held])
    left = left.join(shares, "probe").select(*left.columns, F.pmod("own_chunk", "own_shares").alias("own_share"), every("shares").alias("share"))
    right = made.select(F.col("band").alias("probe"), "chunk", *held)
    right = right.join(shares, "probe").select(*right.columns, F.pmod("chunk", "shares").alias("share"), every("own_shares").alias("own_share"))
    keys = ["probe", "own_share", "share"]
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(n, *keys).join(right.repartition(n, *keys), keys)
    return pairs.where((F.col("own") != F.col("probe")) | (F.col("own_chunk") <= F.col("chunk")))


def near_pairs(one: np.ndarray, other: np.ndarray | None, radius: int, parts: slice, size: int | None, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs within radius and ratio between two tiles, or within one, block by block.

    The pairs of one i stand together.
    """
    within = other is None
    other = one if within else other
    order, others = (np.arange(len(x)) if size is None else np.argsort(x[:, size], kind="stable") for x in (one, other))
    a, b = (np.ascontiguousarray(x[:, parts]).view(np.uint64)[o] for x, o in ((one, order), (other, others)))
    pa_, pb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    if pa_.min() > pb.max() + radius or pb.min() > pa_.max() + radius:
        return
    # of random fingerprints hardly one is within the radius by its first parts; they have 32 bits a part on average
    count = a.shape[1]
    lead = next((p for p in range(1, count) if 32 * p - 12 * math.sqrt(p) >= radius), count)
    first = [np.ascontiguousarray(b[:, p]) for p in range(lead)]
    low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), len(b))
    if size is not None:
        s, t = one[order, size], other[others, size]
        # a little wider than the ratio, which is tested below
        low, high = np.searchsorted(t, s * (ratio * 0.999)), np.searchsorted(t, s / (ratio * 0.999), "right")
    at = 0
    while at < len(a):
        start = max(int(low[at]), at) if within else int(low[at])
        # later rows of a block have wider ranges, so all of its rows are bounded by those of the last
        most = min(len(a) - at, max(1, AT_ONCE // max(1, int(high[at]) - start)))
        end = at + max(1, int(np.searchsorted(np.arange(1, most + 1) * (high[at : at + most] - start), AT_ONCE, "right")))
        stop = int(high[end - 1])
        if stop > start:
            differ = np.bitwise_count(a[at:end, 0, None] ^ first[0][None, start:stop])
            if lead > 3:
                differ = differ.astype(np.uint16)
            for p in range(1, lead):
                differ += np.bitwise_count(a[at:end, p, None] ^ first[p][None, start:stop])
            i, j = np.nonzero(differ <= radius)
            i, j = i + at, j + start
            if within:
                i, j = (x[i < j] for x in (i, j))
            if count > lead and len(i):
                kept = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= radius
                i, j = i[kept], j[kept]
            if size is not None and len(i):
                kept = np.minimum(s[i], t[j]) >= ratio * np.maximum(s[i], t[j])
                i, j = i[kept], j[kept]
            if len(i):
                yield order[i], others[j]
        at = end


def likeness(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of a sorted set with others; none is empty."""
    lengths = np.array([len(x) for x in others])
    joined = np.concatenate(others)
    same = one[np.minimum(np.searchsorted(one, joined), len(one) - 1)] == joined
    common = np.add.reduceat(same, np.cumsum(lengths) - lengths, dtype=np.int64)
    return common / (len(one) + lengths - common)


def forest(
    one: np.ndarray, other: np.ndarray | None, radius: int, parts: slice, size: int | None, ratio: float, sets: tuple[list, list] | None = None,
) -> list[tuple[int, int]]:
    """Links (first field to first field) that connect what is linked between two tiles, or within one.

    With `sets`, the shingles of either side, a link needs a similarity of `ratio` as well.
    """
    within = other is None
    other = one if within else other
    label_a = np.arange(len(one))
    label_b = label_a if within else np.arange(len(one), len(one) + len(other))
    out = []
    for i, j in near_pairs(one, None if within else other, radius, parts, size, ratio):
        while True:
            apart = label_a[i] != label_b[j]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            x, found = i[0], j[:1]
            if sets is not None:
                most = max(1, min(SETS_AT_ONCE, SET_TILE // len(sets[0][x])))
                tested = int(np.argmin(np.append(i[:most] == x, False)))
                found = j[:tested][likeness(sets[0][x], [sets[1][y] for y in j[:tested]]) >= ratio]
                i, j = i[tested:], j[tested:]
            for y in found:
                new, old = label_a[x], label_b[y]
                if new != old:
                    out.append((int(one[x, 0]), int(other[y, 0])))
                    label_a[label_a == old] = new
                    if not within:
                        label_b[label_b == old] = new
    return out


def compared(
    nodes: DataFrame, parts: int, radius: int, ratio: float | None, tile: int, schema: str, found: Callable[..., list[tuple]], sets: bool = False,
) -> DataFrame:
    """What `found` gives for all pairs of tiles that can hold a link; it takes what `forest` takes."""
    banded, probes = bands(nodes, parts, radius, ratio)
    fields = ["f0"] if parts == 1 and ratio is None else ["id", *(f"f{p}" for p in range(parts)), *(["size"] if ratio is not None else [])]
    made, chunks = tiles(banded, fields, tile, sets)
    pairs = tile_pairs(checkpointed(made), chunks, probes, ["items", "sets"] if sets else ["items"])
    same = (F.col("own") == F.col("probe")) & (F.col("own_chunk") == F.col("chunk"))
    width = len(fields)
    where = slice(0, 1) if width == 1 else slice(1, 1 + parts)
    size = None if ratio is None else width - 1
    names = [c.split()[0] for c in schema.split(", ")]

    def shingles(value: pa.ListScalar) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), dtype="<u8") for x in value.values]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, within in enumerate(batch.column(0).to_pylist()):
                one = batch.column(1)[k].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                other = None if within else batch.column(2)[k].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                more = []
                if sets:
                    own = shingles(batch.column(3)[k])
                    more.append((own, own if within else shingles(batch.column(4)[k])))
                rows += found(one, other, radius, where, size, ratio or 0.0, *more)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(len(names))], names=names)

    sent = [*(["own_sets", F.when(~same, F.col("sets")).alias("sets")] if sets else [])]
    return pairs.select(same.alias("same"), "own_items", "items", *sent).mapInArrow(compare, schema)


def links(nodes: DataFrame, parts: int, radius: int, ratio: float | None, tile: int) -> DataFrame:
    """Links (a, b) between node ids that connect all nodes within the radius."""
    return compared(nodes, parts, radius, ratio, tile, "a bigint, b bigint", forest)


def with_candidates(one: np.ndarray, other: np.ndarray | None, *limits) -> list[tuple[int]]:
    """The nodes (first fields) that are within the limits of any other."""
    i_seen = np.zeros(len(one), dtype=bool)
    j_seen = i_seen if other is None else np.zeros(len(other), dtype=bool)
    for i, j in near_pairs(one, other, *limits):
        i_seen[i] = j_seen[j] = True
    ids = one[i_seen, 0] if other is None else np.concatenate([one[i_seen, 0], other[j_seen, 0]])
    return [(x,) for x in ids.tolist()]


def exact_links(docs: DataFrame, text: str, key: str, words: int, nodes: DataFrame, parts: int, radius: int, ratio: float, tile: int, set_tile: int) -> DataFrame:
    """Links between node ids that connect all nodes within the radius whose sets have a similarity of `ratio`.

    Only texts of nodes with candidates are read again, one for each node.
    """
    close = compared(nodes, parts, radius, ratio, tile, "id bigint", with_candidates).distinct()
    close = checkpointed(nodes.join(close, "id", "left_semi"))
    fields = ["id", "size", *(f"f{p}" for p in range(parts))]
    bodies = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).select("key", F.xxhash64("body").alias("text_hash"), "body")
    wanted = close.select(*fields, F.col("one.key").alias("own_key"), F.col("one.text_hash").alias("own_hash"))
    same = F.col("key").eqNullSafe(F.col("own_key")) & (F.col("text_hash") == F.col("own_hash"))
    read = bodies.join(F.broadcast(wanted) if is_small(wanted) else wanted, same).select(*fields, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(x.as_py(), words)).astype("<u8").tobytes() for x in batch.column(len(fields))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(made, pa.binary())], names=[*fields, "set"])

    with_sets = read.mapInArrow(run, ", ".join(f"{n} bigint" for n in fields) + ", set binary")
    # repeated rows
    with_sets = with_sets.groupBy("id").agg(*[F.first(c).alias(c) for c in [*fields[1:], "set"]])
    return compared(checkpointed(with_sets), parts, radius, ratio, set_tile, "a bigint, b bigint", forest, sets=True)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every linked node: large-star and small-star steps until nothing changes."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").where("u != v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now


def near_groups(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, parts: int = 1, radius: int = 2, ratio: float | None = None, tile: int = TILE,
    distinct: bool = False, exact: bool = False, set_tile: int = SET_TILE,
) -> DataFrame:
    """Every row's `key`, `text_hash`, `size`, fingerprint parts and `component_id`.

    Fingerprints of 64 bits a part link at `radius` or fewer differing bits and, with `ratio`, shingle
    counts of at least that ratio; with `distinct` repeated shingles count once. With
    `exact` links need a similarity of `ratio` of the sets of distinct shingles too. The component is named by its smallest key. Null and empty texts
    have the fingerprint zero and link like any other. Repeated rows come out one by one, in one
    component. Null keys are no smallest key; a component of null keys alone has the name null.
    """
    if exact and not (distinct and ratio):
        raise ValueError("exact links compare distinct shingles and need a ratio")
    with small_batches(docs.sparkSession, SENT):  # all that runs Python is checkpointed in here
        prints = checkpointed(fingerprints(docs, text, key, words, parts, distinct))
        columns = [f"f{p}" for p in range(parts)]
        node = F.col("f0") if parts == 1 and ratio is None else F.xxhash64(*columns, *([] if ratio is None else ["size"]))
        prints = prints.withColumn("id", F.col("set_id") if exact else node)
        nodes = prints.groupBy("id").agg(F.min("key").alias("least"), *[F.first(c).alias(c) for c in columns], F.first("size").alias("size"), *([F.min(F.struct("key", "text_hash")).alias("one")] if exact else []))
        nodes = checkpointed(nodes)
        if exact:
            roots = components(exact_links(docs, text, key, words, nodes, parts, radius, ratio, tile, set_tile))
        else:
            roots = components(links(nodes, parts, radius, ratio, tile))
    # a root stands in no row of its own
    members = roots.union(roots.select("root", "root").distinct())
    smallest = members.join(nodes.select("id", "least"), "id").groupBy("root").agg(F.min("least").alias("component"))
    linked = members.join(smallest, "root").select("id", "component")
    named = nodes.join(linked, "id", "left").select("id", F.coalesce("component", "least").alias("component_id"))
    return prints.join(named, "id").select("key", "text_hash", "size", *columns, "component_id")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One document of each group, that with the smallest key, with the columns it had.

    Rows that share both key and text fall or stay together, as do rows whose keys are all null.
    """
    groups = near_groups(docs, text, key, **options)
    dropped = groups.where(~F.col("key").eqNullSafe(F.col("component_id"))).select("key", "text_hash").distinct()
    drop_key, drop_hash = fresh(docs.columns, "drop_key", "drop_hash")
    dropped = checkpointed(dropped.select(F.col("key").alias(drop_key), F.col("text_hash").alias(drop_hash)))
    same = F.col(key).eqNullSafe(F.col(drop_key)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(drop_hash))
    return docs.join(F.broadcast(dropped) if is_small(dropped) else dropped, same, "left_anti")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
