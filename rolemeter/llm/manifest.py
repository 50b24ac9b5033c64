"""A Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Rows are leaves, a tree per source, and the sources' roots are the leaves of one more tree. Every
node starts with a pointer to its parent and the segment of its siblings there. A round joins each
node to the one its pointer names, takes over that one's pointer and appends its segment, so the
distance doubles until all leaves have reached the root. All of it is built-in column functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.llm.shared import numbered, table
from rolemeter.operators.dimensions import is_small, lookup_join
from rolemeter.operators.layout import stored

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node's id is the number of its first leaf times HEIGHTS, plus its height; negative, less one, in the tree of sources.
HEIGHTS = 64
SEGMENTS = "array<struct<left:binary,right:binary>>"


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def written(value: Column) -> Column:
    """A digest as lowercase hex, the form in which it is hashed again."""
    return F.lower(F.hex(value))


def leaf_digest(fields: list[Column]) -> Column:
    """Of the fields in order, each `-` if null, else its count of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return digest(F.concat(*parts))


def levels(nodes: DataFrame, most: int, sign: int, purpose: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every height, stored, and the roots of all trees.

    `nodes` are leaves: `tree`, `n` (leaves of the tree, at most `most`), `place` in it from 0, `node` (its
    id), `first` (the number of its first leaf), `digest`, and `row`, whatever else belongs to it.
    A run is a parent (the same columns but `row`) with its `children`, at most three structs in order. A level is one
    aggregate on numbers and digests; a tree that has come to one node takes part no longer.
    """
    runs, level, roots = [], nodes, nodes.where("n = 1")
    columns = ["tree", "n", "place", "node", "first", "digest"]
    while most > 1:
        height = len(runs) + 1
        here = [c for c in ("place", "node", "first", "digest", "row") if c in level.columns]
        grouped = level.where("n > 1").groupBy("tree", F.ceil(F.col("n") / ARITY).alias("n"), F.floor(F.col("place") / ARITY).alias("place"))
        run = grouped.agg(F.sort_array(F.collect_list(F.struct(*here))).alias("children")).withColumn("first", F.col("children")[0]["first"])
        own = F.col("first") * HEIGHTS + height
        joined = F.array_join(F.transform("children", lambda c: written(c["digest"])), "")
        run = run.select("tree", "n", "place", (own if sign > 0 else -1 - own).alias("node"), "first", digest(joined).alias("digest"), "children")
        runs.append(stored(run, f"{purpose}-{height}"))
        level, most = runs[-1].select(*columns), -(-most // ARITY)
        roots = roots.select(*columns).unionByName(level.where("n = 1"))
    return runs, roots


def edges(runs: list[DataFrame], rows: bool) -> DataFrame | None:
    """`node`, `pointer` to its parent and `segments`, the one of its siblings left and right of it; of leaves with their `row` and `digest`."""
    found = None
    for height, run in enumerate(runs):
        if rows and height:
            break
        beside = lambda k, right: F.unhex(F.array_join(F.transform(
            F.filter("children", lambda c, i: (i > k) if right else (i < k)), lambda c: F.hex(c["digest"])), ""))
        opened = run.select(F.col("node").alias("pointer"), "children", F.posexplode("children").alias("k", "child"))
        kept = ["child.row", "child.digest"] if rows else []
        piece = opened.select(
            "child.node", "pointer", F.array(F.struct(beside(F.col("k"), False).alias("left"), beside(F.col("k"), True).alias("right"))).cast(SEGMENTS).alias("segments"), *kept,
        )
        found = piece if found is None else found.unionByName(piece)
    return found


def jump(rows: DataFrame, targets: DataFrame, root: int, small: bool) -> DataFrame:
    """One round for `rows`: pointer and segments go on by those of the node that the pointer names.

    Rows that point to the root are done; they get keys of their own that name no node, so that they are
    not one key of the join. A node at distance d has at most 3^d leaves, so no key is hot
    while the targets are many; few targets are broadcast.
    """
    done = F.col("pointer") == root
    key = F.when(done, -(1 << 62) - F.abs(F.xxhash64("node") % (1 << 30))).otherwise(F.col("pointer"))
    named = targets.select(F.col("node").alias("target"), F.col("pointer").alias("next"), F.col("segments").alias("more"))
    joined = rows.withColumn("target", key).join(F.broadcast(named) if small else named, "target", "left")
    return joined.select(
        "node", F.coalesce("next", "pointer").alias("pointer"), F.concat("segments", F.coalesce("more", F.array().cast(SEGMENTS))).alias("segments"),
        *[c for c in rows.columns if c not in ("node", "pointer", "segments")],
    )


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Callable[[list[Column]], list[Column]] | None = None) -> DataFrame:
    """One row a document: `id`, `source`, `leaf`, `other`, `subroot`, `root` and `path`, digests as bytes.

    The first field is the id, the second the source. `path` is the siblings, an array of (`left`, `right`) from the leaf's
    run to the root's; `other` is the digest of the fields as `tampered` gives them, by default
    the leaf. Leaves of a source ascend by id, null first, rows of one id by their digest; rows
    equal in all fields are equal leaves, in any order. A null source is one of its own, before all others. A
    source of one row is its own subroot, and a table of one row its own root, with an empty path.
    An empty table gives no rows.
    """
    columns = [F.col(f"`{f}`") for f in fields]
    leaf = leaf_digest(columns)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = stored(docs.select(
        columns[0].alias("id"), columns[1].cast("string").alias("source"), leaf.alias("leaf"), (leaf if tampered is None else leaf_digest(tampered(columns))).alias("other"),
    ), "leaves")
    # rows that repeat differ in `turn`, so that they are dealt to several tasks
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf", "turn"]
    sorted_ = leaves.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = numbered(sorted_.drop("turn"), "number", "numbered").withColumn("source_key", F.to_json(F.struct("source")))  # as JSON null is a key

    sources = stored(placed.groupBy("source_key").agg(F.min("number").alias("tree"), F.count(F.lit(1)).alias("n")), "sources")
    most, n_sources, total = sources.agg(F.max("n"), F.count(F.lit(1)), F.sum("n")).first()
    row = F.struct("id", "source", "tree", "other")
    nodes = lookup_join(placed, sources, "source_key", spread_by="number").select(
        "tree", "n", (F.col("number") - F.col("tree")).alias("place"), (F.col("number") * HEIGHTS).alias("node"), F.col("number").alias("first"), F.col("leaf").alias("digest"), row.alias("row"),
    )
    runs, roots = levels(nodes, most or 0, 1, "runs")
    subroots = stored(roots.select("tree", "node", "first", "digest"), "subroots")
    ranked = numbered(subroots.repartitionByRange(parts, "first").sortWithinPartitions("first"), "place", "ranked")
    tops = ranked.select(F.lit(0).cast("long").alias("tree"), F.lit(n_sources).alias("n"), "place", "node", "first", "digest")
    top_runs, root = levels(tops, n_sources, -1, "top-runs")
    top = root.select("node", "digest").first()

    inner = [e for e in (edges(runs[1:], False), edges(top_runs, False)) if e is not None]
    single = nodes.where("n = 1")  # the leaves that are subroots; their edges are in the tree of sources
    first_edges = edges(runs, True)
    if top_runs:
        own = edges(top_runs[:1], False).join(single.select("node", "row", "digest"), "node")
        first_edges = own if first_edges is None else first_edges.unionByName(own)
    if first_edges is None:  # no row, or one
        first_edges = nodes.select("node", F.col("node").alias("pointer"), F.array().cast(SEGMENTS).alias("segments"), "row", "digest")
    found, distance = first_edges, 1
    if inner:
        targets = inner[0] if len(inner) == 1 else inner[0].unionByName(inner[1])
        while distance < len(runs) + len(top_runs):
            # leaves point to heights of this distance, or into the tree of sources
            wanted = (F.col("node") < 0) | ((F.col("node") % HEIGHTS) % distance == 0)
            targets = stored(targets.where(wanted & (F.col("node") % HEIGHTS != 0)), f"jumps-{distance}")
            small = is_small(targets)
            found = jump(found, targets, top["node"], small)
            targets, distance = jump(targets, targets, top["node"], small), 2 * distance
    with_subroot = lookup_join(
        found.select("row.*", F.col("digest").alias("leaf"), F.col("segments").alias("path"), "node"),
        subroots.select("tree", F.col("digest").alias("subroot")), "tree", spread_by="node",
    )
    return with_subroot.select("id", "source", "leaf", "other", "subroot", F.lit(bytes(top["digest"]) if top else None).cast("binary").alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.lower(F.concat(F.hex(s["left"]), F.hex(node), F.hex(s["right"])))))


def without_line_breaks(columns: list[Column]) -> list[Column]:
    """The fields, the text without its line breaks where the checksum of the id is even."""
    even = F.coalesce(F.crc32(columns[0].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return [*columns[:-1], F.when(even, F.replace(columns[-1], F.lit("\n"), F.lit(""))).otherwise(columns[-1])]


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"), tampered=without_line_breaks)
    siblings = F.array_join(F.transform("path", lambda s: written(F.concat(s["left"], s["right"]))), "")
    found = rows.select("id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("other"), F.col("path")).alias("folded_root"))
    return found.select(
        F.col("id").alias("doc_id"), *[written(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], "proof_sha256",
        written(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS) + ")"
_OTHER = "sha256(" + " || ".join(_FIELD.format(f if f != "text" else "replace(text, chr(10), '')") for f in FIELDS) + ")"
#: The checksum bit by bit: each byte, then seven steps with nothing to add.
_CHECKSUM = """list_reduce(flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: [ascii((doc_id::VARCHAR)[k]), 0, 0, 0, 0, 0, 0, 0]::BIGINT[])),
    lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295)"""
_SIBLINGS = """SELECT s, h, i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM (SELECT *, i // 3 AS p FROM {0} WHERE n > 1) a JOIN (SELECT s, h, i AS i, i // 3 AS p, d FROM {0}) b USING (s, h, p) GROUP BY a.s, a.h, a.i"""

OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, leaf, other, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM (
    SELECT doc_id, {_LEAF} AS leaf, CASE WHEN {_CHECKSUM} & 1 = 1 THEN {_OTHER} ELSE {_LEAF} END AS other, dense_rank() OVER (ORDER BY source NULLS FIRST) AS s FROM documents)
), up AS (
  SELECT s, 0 AS h, i, n, leaf AS d FROM leaves
  UNION ALL SELECT s, h + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY s, h, i // 3, n
), subroots AS (SELECT s, d FROM up WHERE n = 1),
top AS (
  SELECT 0::BIGINT AS s, 0 AS h, s - 1 AS i, (SELECT count(*) FROM subroots) AS n, d FROM subroots
  UNION ALL SELECT s, h + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY s, h, i // 3, n
), beside AS ({_SIBLINGS.format("up").replace("SELECT s, h, i,", "SELECT a.s, a.h, a.i,")}), topbeside AS ({_SIBLINGS.format("top").replace("SELECT s, h, i,", "SELECT a.s, a.h, a.i,")}),
walk AS (
  SELECT doc_id, s, 0 AS h, i, '' AS proof, other AS node FROM leaves
  UNION ALL SELECT w.doc_id, w.s, w.h + 1, w.i // 3, proof || l || r, sha256(l || node || r) FROM walk w JOIN beside b ON w.s = b.s AND w.h = b.h AND w.i = b.i
), topwalk AS (
  SELECT doc_id, 0 AS h, s - 1 AS i, proof, node FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY h DESC) AS k FROM walk) WHERE k = 1
  UNION ALL SELECT w.doc_id, w.h + 1, w.i // 3, proof || l || r, sha256(l || node || r) FROM topwalk w JOIN topbeside b ON w.h = b.h AND w.i = b.i
), ends AS (SELECT doc_id, proof, node FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h DESC) AS k FROM topwalk) WHERE k = 1)
SELECT doc_id, leaf, subroots.d AS subroot, top.d AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = top.d AS verified
FROM leaves JOIN ends USING (doc_id) JOIN subroots USING (s) JOIN top ON top.n = 1
"""
