"""Vector functions: hashed term counts, cosine similarity, mean of the best two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolemeter.functions.core import let
from rolemeter.functions.text import per_chunk, tokens

TOP_CHUNKS = 2


def buckets(words: Column, dim: int) -> Column:
    """Bucket of each word: the first 32 bits of its md5, modulo the dimension.

    Of a power of two only the last digits decide.
    """
    power_of_two = dim & (dim - 1) == 0
    n = max(1, -(-(dim.bit_length() - 1) // 4)) if power_of_two else 8

    def decode(digest: Column) -> Column:
        value = F.conv(F.substring(digest, 9 - n, n), 16, 10).cast("bigint" if n == 8 else "int")
        return value if dim == 16 ** n else (value % F.lit(dim)).cast("int")

    return F.transform(F.transform(words, lambda w: F.md5(w.cast("binary"))), decode)


def term_buckets(text: Column, dim: int) -> Column:
    """Sorted buckets of all tokens of a text, one entry per token."""
    return F.sort_array(buckets(tokens(text), dim))


def squared_norm(sorted_buckets: Column) -> Column:
    """Sum of squared bucket counts, from the places where a new bucket starts."""
    starts = F.filter(
        F.transform(
            sorted_buckets, lambda b, i: F.when((i == 0) | (b != F.get(sorted_buckets, i - 1)), i)
        ),
        lambda i: i.isNotNull(),
    )

    def total(places: Column) -> Column:
        ends = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.size(sorted_buckets)))
        counts = F.zip_with(places, F.slice(ends, 1, F.size(places)), lambda start, end: end - start)
        return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, n: acc + n * n)

    return let(starts, total)


def with_norm(sorted_buckets: Column) -> Column:
    return let(
        sorted_buckets,
        lambda b: F.struct(b.alias("buckets"), F.sqrt(squared_norm(b).cast("double")).alias("norm")),
    )


def sparse_vector(text: Column, dim: int) -> Column:
    """Hashed term-count vector of a text as its sorted buckets and its norm."""
    return with_norm(term_buckets(text, dim))


def chunk_vectors(text: Column, size: int, dim: int) -> Column:
    """Vectors of all chunks of a text.

    Sentences are hashed once and their buckets put together per chunk, as tokens do not run
    across the space between two sentences.
    """
    gathered = per_chunk(
        text,
        size,
        lambda texts: F.transform(texts, lambda t: buckets(tokens(t), dim)),
        lambda _, hashed, i: F.flatten(F.slice(hashed, i + 1, F.lit(size))),
    )
    return F.transform(gathered, lambda b: with_norm(F.sort_array(b)))


def dense_counts(sorted_buckets: Column, dim: int) -> Column:
    """Term counts laid out by bucket. Meant for the few, short skill queries."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.size(F.filter(sorted_buckets, lambda b: b == i)).cast("bigint"),
    )


def any_counts(laid_out: Column) -> Column:
    """For an array of laid-out counts, whether any of them has a bucket."""
    return F.aggregate(
        F.slice(laid_out, 2, F.greatest(F.size(laid_out) - 1, F.lit(0))),
        F.transform(F.get(laid_out, F.lit(0)), lambda n: n > 0),
        lambda acc, counts: F.zip_with(acc, counts, lambda seen, n: seen | (n > 0)),
    )


def only_buckets(vector: Column, wanted: Column) -> Column:
    """A sparse vector without the buckets no query has; its norm stays that of the whole."""
    return F.struct(
        F.filter(vector.buckets, lambda b: F.get(wanted, b)).alias("buckets"), vector.norm.alias("norm")
    )


def sparse_cosine(counts: Column, query_norm: Column, vector: Column) -> Column:
    """Cosine of a laid-out query and a sparse vector. A zero norm gives 0.

    Summing the query's count at every token's bucket equals the dot product of the two
    count vectors, and stays in integers.
    """
    dot = F.aggregate(
        vector.buckets, F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(counts, b)
    )
    scale = query_norm * vector.norm
    return F.when(scale > 0, dot.cast("double") / scale).otherwise(F.lit(0.0))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    """Dot product of two arrays of doubles."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda acc, p: acc + p)


def dense_norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def dense_cosine(left: Column, left_norm: Column, right: Column, right_norm: Column) -> Column:
    """Cosine of two dense vectors with known norms; a zero vector gives 0."""
    scale = left_norm * right_norm
    return F.when(scale > 0, dot(left, right) / scale).otherwise(F.lit(0.0))


def best_mean(similarities: Column, k: int = TOP_CHUNKS) -> Column:
    """Mean of the k highest values, of all of them when there are fewer; null when empty."""

    def mean(best: Column) -> Column:
        total = F.aggregate(best, F.lit(0.0), lambda acc, s: acc + s)
        return F.when(F.size(best) > 0, total / F.size(best).cast("double"))

    return let(F.slice(F.sort_array(similarities, asc=False), 1, k), mean)
