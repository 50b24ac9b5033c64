"""Exact deduplication by progressive refinement: length, then a hash of the start, then of all.

Rows are grouped by the length of their text; only lengths that occur more than once go on to a
hash of the first bytes, and only groups that still have several rows are read whole. What is
grouped and moved is numbers, never text. All of it is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.llm.shared import checkpointed, fresh, table
from rolemeter.operators.dimensions import is_small

PREFIX_BYTES = 256


def _several(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", normalised: Column | None = None) -> DataFrame:
    """The documents with `keep_id`, `group_size`, `kept`, `tied` and `full_hash`.

    Texts are equal when `normalised` (by default the text itself, null as empty) is identical. Of
    equal texts the row with the largest id is kept. `full_hash` (SHA-256 in hex) is null for texts
    that needed no full reading. Rows that repeat the largest id of their group are all marked
    kept and `tied`, as nothing tells them apart; `deduplicated` lets one of them stay. A null id
    is smaller than any other; if all ids of a group are null, all its rows are tied.
    """
    body = F.coalesce(F.col(text), F.lit("")) if normalised is None else normalised
    names = fresh(docs.columns, "keep_id", "group_size", "kept", "tied", "full_hash", "size", "prefix", "several")
    keep_id, group_size, kept, tied, full_hash, size, prefix, several = names
    length, start = F.octet_length(body), F.xxhash64(F.substring(F.encode(body, "UTF-8"), 1, PREFIX_BYTES))

    # first and second round, on numbers only; their outcome is what the third round needs to know
    keyed = docs.select(length.alias(size), start.alias(prefix)).groupBy(size, prefix).agg(F.count(F.lit(1)).alias("n"))
    lengths = keyed.groupBy(size).agg(F.sum("n").alias("rows")).where("rows > 1").select(size)
    open_groups = checkpointed(keyed.where("n > 1").join(lengths, size, "left_semi").select(size, prefix))

    # third round: full hashes of the rows whose length and start others share
    flagged = _flag(docs.withColumn(size, length).withColumn(prefix, start), open_groups, [size, prefix], several)
    hashed = flagged.withColumn(full_hash, F.when(F.col(several), F.sha2(body, 256)))
    groups = checkpointed(
        hashed.where(F.col(several)).groupBy(size, prefix, full_hash, F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(size, prefix, full_hash)
        .agg(F.sum("n").alias(group_size), F.max(F.struct(F.col("id"), F.col("n"))).alias("last"))
        .where(F.col(group_size) > 1)
        .select(size, prefix, full_hash, group_size, F.col("last.id").alias(keep_id), (F.col("last.n") > 1).alias(tied))
    )
    joined = hashed.join(F.broadcast(groups) if is_small(groups) else groups, [size, prefix, full_hash], "left")
    own = F.coalesce(F.col(group_size), F.lit(1).cast("long"))
    return joined.select(
        *docs.columns,
        F.when(own > 1, F.col(keep_id)).otherwise(F.col(key)).alias(keep_id), own.alias(group_size),
        F.when(own > 1, F.col(key).eqNullSafe(F.col(keep_id))).otherwise(F.lit(True)).alias(kept),
        (F.coalesce(F.col(tied), F.lit(False)) & F.col(key).eqNullSafe(F.col(keep_id))).alias(tied), F.col(full_hash),
    )


def _flag(rows: DataFrame, groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Mark rows whose keys are in `groups`. Proven small, these are broadcast; else both sides shuffle."""
    marked = groups.withColumn(name, F.lit(True))
    joined = rows.join(F.broadcast(marked) if is_small(marked) else marked, keys, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", normalised: Column | None = None) -> DataFrame:
    """One row of each group of equal texts, with the columns it had."""
    grouped = exact_groups(docs, text, key, normalised)
    keep_id, group_size, kept, tied, full_hash = grouped.columns[-5:]
    rows = grouped.where(F.col(kept))
    single = rows.where(~F.col(tied)).select(*docs.columns)
    one = (
        rows.where(F.col(tied))
        .groupBy(full_hash).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*[c for c in docs.columns if c != text])).alias("row"))
        .select("row.*")
    )
    return single.unionByName(one)


def op8_exact(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.coalesce("full_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_sha256"),
    )


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
