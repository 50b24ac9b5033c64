"""The audit of filters, the manifest and the quality rules against plain versions, on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolemeter.llm import audit, manifest, quality
from rolemeter.llm.registry import ORACLE, REGISTRY
from tests.llm.helpers import empty, frame, near_texts, odd, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = ("documents", "labels")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_manifest", "op13_quality"])
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = REGISTRY[name](spark, sf_dir)
    want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE[name]})").fetchall()
    assert rows(found) == sorted(want, key=repr)


def mixed_texts():
    base = [*near_texts(groups=6, words=260), "many " * 300]
    noisy = ["Shouting LOUD Words " * 90, "few few few " * 100, "with # sign " * 80, "", " \n ", "é ü " * 120, "UPPER"]
    return [*base, *noisy, *base[:4], noisy[0], noisy[3]]


# the audit


def test_words_are_numbered_alike_in_all_shards(spark, monkeypatch):
    texts = [t or "" for t in mixed_texts()]
    monkeypatch.setattr(audit, "SHARD_BYTES", 2000)
    monkeypatch.setattr(audit, "PLACES", 100)
    matrix, dictionary = audit.term_matrix(frame(spark, texts).repartition(3), keep=("doc_id", "Score"))
    words = {r["id"]: r["word"] for r in dictionary.collect()}
    assert sorted(words) == list(range(len(words))) and len(set(words.values())) == len(words)
    assert set(words.values()) == {w for t in texts for w in WORD.findall(t)}
    found, shards = {}, matrix.collect()
    assert len(shards) > 3
    for r in shards:
        ends, ids = (audit.unpacked([pa.scalar(bytes(r[c]))], kind) for c, kind in (("indptr", "i4"), ("indices", "i8")))
        counts = audit.unpacked_counts([pa.scalar(bytes(r["data"]))], len(ids))
        for k, key in enumerate(r["doc_id"]):
            found[key] = Counter({words[int(ids[x])]: int(counts[x]) for x in range(ends[k], ends[k + 1])})
    assert found == {i: Counter(WORD.findall(t)) for i, t in enumerate(texts)}


def plain_audit(docs, labels):
    """`docs`: (id, text, part). Every order, filter by filter."""
    marks = {}
    for key, good, toxic in labels:
        a, b = marks.get(key, (0, 0))
        marks[key] = (max(a, good == 1), max(b, toxic == 1))
    fails = []
    for key, text, part in docs:
        t = text or ""
        words = WORD.findall(t)
        others = [k for k, x, _ in docs if (x or "") == t and k is not None]
        copied = any(key is None or k < key for k in others)
        flags = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copied)
        fails.append((part or "", {c for c, f in zip("ABCDE", flags) if f}, *marks.get(key, (0, 0))))
    out = []
    for part in {f[0] for f in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        total = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = list(own)
            gone = []
            for step, c in enumerate(order, 1):
                removed = [f for f in left if c in f[0]]
                redundant = sum(c in f[0] for f in gone)
                left = [f for f in left if c not in f[0]]
                gone += removed
                total[c] += len(removed)
                steps.append(("".join(order), step, c, len(left), len(removed), redundant, sum(f[0] == {c} for f in own), sum(f[1] for f in removed), sum(f[2] for f in removed)))
        out += [(part, o, s, k, r, d, u, g, t, total[c]) for o, s, c, k, r, d, u, g, t in steps]
    return sorted(out, key=repr)


def test_audit_of_odd_rows(spark):
    texts = mixed_texts()
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "").otherwise("en"))
    docs = docs.unionByName(odd(spark)).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id < 3"))
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (2, 1, 1), (9, None, 1), (None, 1, 1), (10, 1, None)], "doc_id long, quality int, toxic int")
    found = rows(audit.interactions(audit.failures(docs), labels))
    plain = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    want = plain_audit(plain, [tuple(r) for r in labels.where("doc_id IS NOT NULL").collect()])
    assert found == want
    assert len(found) == 600 * 2


def test_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.failures(empty(spark)), labels).isEmpty()
    assert audit.term_matrix(empty(spark))[1].isEmpty()


# the manifest


def plain_hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return plain_hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """The root of a list of leaves, and of each leaf its (left, right) siblings."""
    level, paths = [(d, [i]) for i, d in enumerate(digests)], [[] for _ in digests]
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for run in runs:
            for k, (_, leaves) in enumerate(run):
                for i in leaves:
                    paths[i].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
        level = [(plain_hash("".join(d for d, _ in run)), [i for _, leaves in run for i in leaves]) for run in runs]
    return level[0][0], paths


def plain_manifest(table):
    """`table`: rows of the fields. What `op12_manifest` gives, in any order."""
    by_source = {}
    for r in table:
        by_source.setdefault(r[1], []).append((plain_leaf(r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])) for s in order}
    climbed = {s: climb([d for d, _ in trees[s]]) for s in order}
    root, above = climb([climbed[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, above):
        for (leaf, r), path in zip(trees[s], climbed[s][1]):
            path = [*path, *top]
            changed = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[-1] is not None:
                changed[-1] = r[-1].replace("\n", "")
            node = plain_leaf(changed)
            for left, right in path:
                node = plain_hash(left + node + right)
            out.append((r[0], leaf, climbed[s][0], root, plain_hash("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def proofs(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return rows(manifest.op12_manifest(spark, str(tmp_path)))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2], [3], [4], [1, 1, 1, 1], [28, 1, 5], [10, 9, 81, 1, 1, 1, 2, 3, 1, 1]])
def test_proofs_of_trees_of_any_shape(spark, tmp_path, sizes):
    r = random.Random(len(sizes))
    texts = ["\n".join(r.choice(["a", "bé", "", "cc"]) for _ in range(4)) for _ in range(sum(sizes))]
    sources = [f"s{k}" if k else None for k, n in enumerate(sizes) for _ in range(n)]
    docs = frame(spark, texts, first=7, sources=sources).withColumn("n_chars", F.length("text").cast("long"))
    want = plain_manifest([tuple(x) for x in docs.select(*manifest.FIELDS).collect()])
    assert proofs(spark, docs.repartition(3), tmp_path) == want


def test_proofs_of_odd_rows(spark, tmp_path):
    docs = odd(spark).withColumn("source", F.when(F.col("doc_id") == 3, None).when(F.col("doc_id") == 4, "").otherwise(F.col("source")))
    assert proofs(spark, docs, tmp_path) == plain_manifest([tuple(x) for x in docs.select(*manifest.FIELDS).collect()])


def test_manifest_of_an_empty_table(spark):
    assert manifest.manifest(empty(spark)).isEmpty()


# quality


def plain_counts(text):
    t = text or ""
    words = WORD.findall(t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    held = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(held)


def test_counts_of_texts(spark):
    r = random.Random(3)
    few = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(60)]
    lines = ["\n".join(r.choice(["x y", "x  y", " ", "", "x y ", "<b> 5 %"]) for _ in range(12)) for _ in range(20)]
    phrase = " ".join(f"p{i}" for i in range(8))
    texts = [*few, *lines, f"{phrase} {phrase}", f"{phrase} z {phrase}", f"{phrase} p0", "a " * 9, "a " * 8, "𝔘 é x \x1c"]
    docs = odd(spark).unionByName(frame(spark, texts, first=100))
    found = quality.measured(docs)
    counts = found.columns[-6:]
    assert rows(found.select("doc_id", *counts)) == sorted([(d["doc_id"], *plain_counts(d["text"])) for d in docs.collect()], key=repr)


def test_limits_follow_the_group(spark):
    """What is odd in one source is usual in another, and few documents are judged with their language."""
    r = random.Random(5)
    plain = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(60))
    tables = lambda: " ".join(f"{w}|" for w in plain().split())
    texts = [plain() for _ in range(quality.MIN_GROUP)] + [tables()] + [tables() for _ in range(quality.MIN_GROUP)] + [plain(), tables()]
    sources = ["prose"] * (quality.MIN_GROUP + 1) + ["tables"] * quality.MIN_GROUP + ["small"] * 2
    found = {x["key"]: x for x in quality.judged(frame(spark, texts, sources=sources)).collect()}
    assert not found[quality.MIN_GROUP]["kept"] and found[quality.MIN_GROUP]["outside"] == "symbol_share"
    assert all(found[i]["kept"] for i in range(len(texts)) if i != quality.MIN_GROUP)
    assert [found[i]["level"] for i in (0, quality.MIN_GROUP + 1, len(texts) - 1)] == ["source", "source", "lang"]


def test_sketches_merge_and_hold_their_bound(spark):
    values = [0, 1, 31, 63, 64, 65, 127, 128, 1000, 4095, 4096, 10**6, 10**12]
    got = [x["b"] for x in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket(F.col("v")).alias("b")).collect()]
    assert all(b <= v and (v - b) * 32 <= v for v, b in zip(values, got)) and got[:4] == values[:4]


def test_quality_of_odd_and_no_rows(spark):
    docs = odd(spark).withColumn("lang", F.when(F.col("doc_id") != 5, F.col("lang")))
    found = quality.judged(docs)
    assert found.count() == docs.count()
    want = [(n < 20 or 100 * rep > 30 * n) for n, _, _, _, _, rep in (plain_counts(d["text"]) for d in docs.collect())]
    assert sorted(x["base_failed"] for x in found.collect()) == sorted(want)
    assert quality.judged(empty(spark)).isEmpty()
    kept = quality.filtered(frame(spark, [*near_texts(), "too few"]).unionByName(docs))
    assert kept.columns == docs.columns and kept.where("text = 'too few' OR text IS NULL").isEmpty() and kept.count() == len(near_texts())
