"""Small documents with everything odd in them, and random ones."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
    T.StructField("Score", T.StringType()), T.StructField("body", T.StringType()),
])
ODD = [
    None, "", " \n\t ", "a", "aaaaaaaa", "word " * 30_000, "Repeated row of some words", "Repeated row of some words",
    "Ünïcode ẞ 𝔘𝔫𝔦 é e\u0301 <|endoftext|> it's 12,5 \x1c x", "Licensed under the MIT License. token = abcdef123456",
    "under-the_mit\nlicense; CC BY NC and cc-by-nc; Apache License, Version 2.0",
]


def frame(spark, texts, first=0, sources=None):
    """Documents whose extra columns clash with names the operators use."""
    rows = [
        (None if isinstance(t, tuple) else i, t[0] if isinstance(t, tuple) else t, "en", sources[k] if sources else f"s{k % 3}", None, "x", "y", "z")
        for k, (i, t) in enumerate(enumerate(texts, first))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """All odd texts, one row twice, and one row without an id."""
    docs = frame(spark, [*ODD, ("no id here but some words",)])
    return docs.union(docs.where("doc_id = 6"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_texts(seed=5, groups=12, words=120):
    """Groups of near copies, some exact, among unrelated texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    texts = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(words)]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                copy[r.randrange(words)] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


def rows(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)
