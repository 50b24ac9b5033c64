"""Similarities from dense vectors: precomputed ones, or a model supplied by the caller.

Either way the vectors arrive as rows, one per chunk. A skill's similarity is the mean of its
two best chunks; the two are picked before the shuffle in every partition, so a document with
a large share of all chunks moves two rows per partition and skill.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolemeter.functions.core import round_exact
from rolemeter.functions.text import chunks
from rolemeter.functions.vectors import TOP_CHUNKS, dense_cosine, dense_norm, doubles
from rolemeter.operators.dimensions import is_small, lookup_join
from rolemeter.operators.identity import document_columns
from rolemeter.operators.layout import stored
from rolemeter.sources.profiles import query_text


def chunk_rows(resumes: DataFrame, size: int = 3) -> DataFrame:
    """Chunks of every resume: `resume_id, target_role, chunk_no, chunk`."""
    return resumes.select(
        *document_columns(resumes), F.posexplode(chunks(F.col("text"), size)).alias("chunk_no", "chunk")
    )


def _with_norms(chunk_vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    chunk = chunk_vectors.select(*document_columns(chunk_vectors), "chunk_no", doubles(F.col("embedding")).alias("embedding"))
    query = queries.select("role", "skill", doubles(F.col("embedding")).alias("query"))
    return chunk.select("*", dense_norm(F.col("embedding")).alias("norm")), query.select("*", dense_norm(F.col("query")).alias("query_norm"))


def _with_queries(chunk_vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Chunks with all queries of their role as one array; for queries of checked size."""
    chunk, query = _with_norms(chunk_vectors, queries)
    per_role = query.groupBy("role").agg(F.collect_list(F.struct("skill", "query", "query_norm")).alias("queries"))
    return chunk.join(F.broadcast(per_role), F.col("target_role") == F.col("role"))


def _scored() -> Column:
    return F.transform("queries", lambda q: F.struct(
        q.skill.alias("skill"),
        dense_cosine(q.query, q.query_norm, F.col("embedding"), F.col("norm")).alias("similarity"),
    ))


def chunk_similarities(chunk_vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Similarity of every chunk to the skills of its role: `resume_id, target_role, chunk_no, skill, similarity`.

    `chunk_vectors` has `resume_id, target_role, chunk_no, embedding`; `queries`, one row per
    role skill, has `role, skill, embedding`. When the queries are small, the skills of a role
    meet a chunk as one broadcast array and no vector is copied per pair.
    """
    chunk, query = _with_norms(chunk_vectors, queries)
    own = document_columns(chunk_vectors)
    if is_small(queries):
        joined, scored = _with_queries(chunk_vectors, queries), _scored()
        return joined.select(*own, "chunk_no", F.inline(scored))
    pairs = lookup_join(chunk, query.withColumnRenamed("role", "target_role"), "target_role", small=False, spread_by=["resume_id", "chunk_no"])
    similarity = dense_cosine(F.col("query"), F.col("query_norm"), F.col("embedding"), F.col("norm"))
    return pairs.select(*own, "chunk_no", "skill", similarity.alias("similarity"))


def closest(chunk_vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The closest skill of every chunk: `resume_id, target_role, chunk_no, skill, similarity`.

    Similarities are compared after rounding to three places, ties by the later skill. Where the
    queries fit a broadcast, the maximum is taken in the chunk's own row and no pair leaves it.
    """
    best = F.struct(round_exact(F.col("similarity"), 3).alias("similarity"), "skill")
    if not is_small(queries):
        pairs = chunk_similarities(chunk_vectors, queries)
        found = pairs.groupBy("resume_id", "target_role", "chunk_no").agg(F.max(best).alias("best"))
    else:
        scored = F.transform(_scored(), lambda p: F.struct(round_exact(p.similarity, 3).alias("similarity"), p.skill.alias("skill")))
        found = _with_queries(chunk_vectors, queries).select("resume_id", "target_role", "chunk_no", F.array_max(scored).alias("best"))
        found = found.where(F.col("best").isNotNull())
    return found.select("resume_id", "target_role", "chunk_no", "best.skill", "best.similarity")


def best_chunks(similarities: DataFrame, k: int = TOP_CHUNKS, found_only: bool = False) -> DataFrame:
    """Mean of the k best chunks per resume, role and skill: `resume_id, target_role, skill, similarity`, and a `doc_key` they have.

    With `found_only`, pairs of similarity 0 may be absent and the plain `total` is returned.
    """
    own = document_columns(similarities)
    order = Window.partitionBy(*own, "skill").orderBy(F.desc("similarity"), "chunk_no")
    best = similarities.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    total = F.sum("similarity")
    value = total.alias("total") if found_only else (total / F.count(F.lit(1))).alias("similarity")
    return best.groupBy(*own, "skill").agg(value)


def as_map(similarities: DataFrame) -> DataFrame:
    """One row per resume and role with its similarities keyed by skill, for `Semantic("given")`."""
    entries = F.collect_list(F.struct("skill", "similarity"))
    return similarities.groupBy(*document_columns(similarities)).agg(F.map_from_entries(entries).alias("similarities"))


def embedded_once(texts: DataFrame, column: str, embed: Callable, vectors: str | None = None) -> DataFrame:
    """`texts` with `embedding` in place of the text in `column`; the model sees each distinct text once.

    Texts are told apart by their SHA-256. With `vectors`, a folder of `digest, embedding` in Parquet, those of
    earlier runs are taken from there and the new ones are added, so later runs and batches embed
    only what they have not seen. Runs that share a folder may both embed a text; either vector serves.
    """
    spark = texts.sparkSession
    keyed = stored(texts.withColumn("_digest", F.unhex(F.sha2(column, 256))), "texts")
    new = keyed.groupBy("_digest").agg(F.first(column).alias(column))
    known = None
    if vectors is not None and _exists(spark, vectors):
        known = spark.read.parquet(vectors).groupBy(F.col("digest").alias("_digest")).agg(F.first("embedding").alias("embedding"))
        new = new.join(known.select("_digest"), "_digest", "left_anti")
    made = stored(new.select("_digest", embed(F.col(column)).alias("embedding")), "vectors")
    if vectors is not None:
        made.select(F.col("_digest").alias("digest"), "embedding").write.mode("append").parquet(vectors)
        known = made if known is None else made.unionByName(known)
    return keyed.drop(column).join(made if known is None else known, "_digest").drop("_digest")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def model_similarities(
    resumes: DataFrame, role_skills: DataFrame, embed: Callable, size: int = 3, vectors: str | None = None, roles: Column | None = None
) -> DataFrame:
    """`resume_id, target_role, similarities` computed by a model, by `doc_key` if the resumes have one.

    With `roles`, an array made of the other two columns, a resume asks for each of these, and is cut into chunks once.

    `embed` maps a text column to a vector column, typically a `predict_batch_udf`, which loads
    the model once per Python worker. Equal chunks, and equal queries, are embedded once; `vectors`
    names a folder that keeps their vectors for later runs.
    """
    queries = embedded_once(
        query_text(role_skills.where(F.col("skill").isNotNull())).select("role", "skill", "query_text"), "query_text", embed, vectors
    )
    chunk_vectors = embedded_once(chunk_rows(resumes, size), "chunk", embed, vectors)
    if roles is not None:
        chunk_vectors = chunk_vectors.withColumn("target_role", F.explode(roles))
    return as_map(best_chunks(chunk_similarities(chunk_vectors, queries)))


def stored_similarities(chunk_vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """`resume_id, target_role, similarities` from chunk and query vectors computed earlier."""
    return as_map(best_chunks(chunk_similarities(chunk_vectors, queries)))
