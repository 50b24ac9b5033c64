"""Column functions on hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from rolemeter.functions import keywords as K
from rolemeter.functions import scoring as S
from rolemeter.functions import text as X
from rolemeter.functions import vectors as V
from rolemeter.functions.core import round_exact
from rolemeter.sources.files import decode_txt


def test_rounding_is_half_even_on_the_binary_value(values):
    rng = random.Random(7)
    inputs = [5 + i / 1000 for i in range(93_001)]
    inputs += [rng.uniform(0, 100) for _ in range(20_000)]
    inputs += [-x for x in inputs[:500]] + [16.25, 0.15, 0.25, 0.05, 2.5, 54.35 - 7e-15, 0.0, 99.95]
    assert values(lambda v: round_exact(v, 1), inputs, "double") == [round(x, 1) for x in inputs]


def test_rounding_small_values_to_three_digits(values):
    rng = random.Random(8)
    inputs = [rng.uniform(-1, 1) for _ in range(20_000)] + [k / 16 / 125 for k in range(2000)]
    inputs += [0.0625, 0.1875, 0.0005, 0.0015, 0.0025, 1e-12, 0.0625 + 1e-17]
    assert values(lambda v: round_exact(v, 3), inputs, "double") == [round(x, 3) for x in inputs]


@pytest.mark.parametrize("raw, expected", [
    (None, ""),
    ("", ""),
    ("a b​c", "a bc"),
    ("a \t  b", "a b"),
    ("a\tb", "a b"),
    ("a\n\n\n\nb", "a\n\nb"),
    ("a\n   \r\n b", "a\n\n b"),
    ("a \n\nb", "a \n\nb"),
    ("a\nb", "a\nb"),
    ("　\x1f a \x85\n", "a"),
])
def test_normalize(value, raw, expected):
    assert value(X.normalize(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize("raw, expected", [
    ("•\t- abcdefghijkl –* ", ["abcdefghijkl"]),
    ("one sentence here. another one there! short. and a third?", ["one sentence here.", "another one there!", "and a third?"]),
    ("no cut at 3.14159 or v1.2.3", ["no cut at 3.14159 or v1.2.3"]),
    ("ends with a stop.\n  next line starts", ["ends with a stop.", "next line starts"]),
    ("ten chars.\neleven char", ["eleven char"]),
    ("", []),
])
def test_sentences(value, raw, expected):
    assert value(X.sentences(F.lit(raw))) == expected


def test_chunks_overlap_by_one_sentence(value):
    a, b, c, d = ("sentence number one", "sentence number two", "sentence number three", "sentence number four")
    assert value(X.chunks(F.lit("\n".join([a, b, c])))) == [f"{a} {b} {c}", c]
    assert value(X.chunks(F.lit("\n".join([a, b, c, d])))) == [f"{a} {b} {c}", f"{c} {d}"]
    assert value(X.chunks(F.lit("\n".join([a, b, c])), 1)) == [a, b, c]
    assert value(X.chunks(F.lit("\n".join([a, b, c])), 2)) == [f"{a} {b}", f"{b} {c}", c]


def test_chunk_fallbacks(value):
    assert value(X.chunks(F.lit(""))) == ["General resume content"]
    assert value(X.chunks(F.lit("tiny\n" * 300))) == [("tiny\n" * 300)[:500]]
    assert value(X.chunks(F.lit("twelve chars"))) == ["twelve chars"]


def test_short_last_window_is_dropped(value):
    text = "a first long sentence\na second long sentence\nthird piece"
    assert value(X.chunks(F.lit(text))) == ["a first long sentence a second long sentence third piece"]


@pytest.mark.parametrize("text, keyword, hit", [
    ("i know c++ well", "c++", False),
    ("i know c++17", "C++", True),
    ("use .net", ".net", False),
    ("asp.net", ".net", True),
    ("c# dev", "c#", False),
    ("my_sql_db", "sql", True),
    ("mysql", "sql", False),
    ("élan", "lan", False),
    ("Ci/CD in use", "ci/cd", True),
    ("unit² test", "unit", False),
    ("a.b", "a.b", True),
    ("axb", "a.b", False),
    ("machine learning", "machine learning", True),
    ("machine\nlearning", "machine learning", False),
    ("anything", "", True),
    ("...", "", False),
    ("x --- y", "---", False),
    ("x---y", "---", True),
    ("sql sqlx", "sql", True),
    ("sqlx sql", "sql", True),
])
def test_keyword_boundaries(value, text, keyword, hit):
    probe = K.probes(F.array(F.lit(keyword)))[0]
    assert value(K.found(F.lower(F.lit(text)), probe)) is hit


@pytest.mark.parametrize("hits, total, ratio", [(0, 0, 0.5), (0, 3, 0.0), (1, 3, 1 / 3), (2, 8, 0.5), (4, 9, 1.0), (6, 9, 1.0)])
def test_keyword_ratio(value, hits, total, ratio):
    assert value(K.keyword_ratio(F.lit(hits), F.lit(total))) == ratio


@pytest.mark.parametrize("semantic, hits, total, score", [
    (0.0, 1, 4, 16.2),
    (0.0, 4, 4, 50.0),
    (0.0, 0, 0, 22.5),
    (0.0, 0, 4, 5.0),
    (1.0, 4, 4, 98.0),
])
def test_score_arithmetic(value, semantic, hits, total, score):
    ratio = K.keyword_ratio(F.lit(hits), F.lit(total))
    assert value(round_exact(S.blend(F.lit(semantic), ratio, F.lit(hits)), 1)) == score


def test_bands_start_at_their_bound(values):
    scores = [98.0, 80.0, 79.9, 65.0, 64.9, 50.0, 49.9, 35.0, 34.9]
    assert values(S.level, scores, "double") == [
        "Expert / Strong", "Expert / Strong", "Proficient", "Proficient", "Moderate Competency",
        "Moderate Competency", "Needs Improvement", "Needs Improvement", "Critical Gap",
    ]
    assert [t.split(" - ")[0] for t in values(S.tier, [80.0, 79.9, 60.0, 59.9], "double")] == [
        "Interview Ready", "Nearly Ready", "Nearly Ready", "Foundational Stage",
    ]


def test_report_texts(value, values):
    assert values(S.weight_percent, [0.29, 0.3, 0.1, 1.0], "double") == [28, 30, 10, 100]
    assert values(S.benchmark_delta, [70.0, 86.3, 55.5], "double") == [
        "Benchmark Baseline", "16.3% vs. Benchmark", "-14.5% vs. Benchmark",
    ]
    assert value(S.missing_display(F.array().cast("array<string>"))) == "Key frameworks & concepts"
    assert value(S.matched_display(F.array(*[F.lit(c) for c in "abcde"]))) == "a, b, c, d"


def test_calibration_defaults(values):
    assert values(S.calibrate, [0.1, 0.2, 0.65, 0.9], "double") == [0.0, 0.0, 1.0, 1.0]


def test_texts_with_nothing_to_squeeze_are_left_as_they_are(values):
    odd = ["a  b", "a\tb", "a\u00a0b", "a\u200bb", "a \u200b b", "a \u00a0\t b"]
    assert values(X.squeeze, ["", "a b\nc", None, *odd], "string") == ["", "a b\nc", "", "a b", "a b", "a b", "ab", "a b", "a b"]


@pytest.mark.parametrize("dim", [1, 2, 16, 100, 256, 4096, 5000])
def test_buckets_are_the_first_32_bits_of_md5(spark, dim):
    words = spark.range(500).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"))
    expected = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("bigint") % dim
    assert words.where(V.buckets(F.array("w"), dim)[0] != expected).count() == 0


def test_sparse_cosine_equals_dense_cosine_of_the_counts(spark):
    texts = spark.range(40).select(
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.col("id") % 9 + 1), lambda i: (i * i % 5).cast("string"))).alias("a"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.col("id") % 7 + 1), lambda i: (i * 3 % 8).cast("string"))).alias("b"),
    )
    rows = texts.select(V.sparse_vector(F.col("a"), 64).alias("a"), V.sparse_vector(F.col("b"), 64).alias("b"))
    dense = lambda name: V.doubles(V.dense_counts(F.col(f"{name}.buckets"), 64))
    both = rows.select(
        V.sparse_cosine(V.dense_counts(F.col("a.buckets"), 64), F.col("a.norm"), F.col("b")).alias("sparse"),
        V.dense_cosine(dense("a"), V.dense_norm(dense("a")), dense("b"), V.dense_norm(dense("b"))).alias("dense"),
    )
    found = both.collect()
    assert len(found) == 40 and all(abs(r.sparse - r.dense) < 1e-12 for r in found)


def test_best_mean(value):
    sims = [F.array(*[F.lit(x) for x in xs]) for xs in ([0.5], [0.1, 0.4, 0.2], [-0.5, -0.1])]
    assert [value(V.best_mean(s)) for s in sims] == [0.5, (0.4 + 0.2) / 2, -0.3]


@pytest.mark.parametrize("raw, expected", [
    (b"\xffA", "ÿA"),
    (b"\xef\xbb\xbfA", "﻿A"),
    ("été".encode(), "été"),
    ("été".encode("latin-1"), "été"),
])
def test_decoding(value, raw, expected):
    assert value(decode_txt(F.lit(raw))) == expected
