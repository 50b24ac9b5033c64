"""Fingerprints, mixing, packing, near and exact groups, toxicity and the pipeline against plain versions."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rolemeter.llm import exact, fingerprints, mixing, packing, shared, simhash, toxicity
from rolemeter.llm.registry import ORACLE, REGISTRY
from tests.llm.helpers import ODD, empty, frame, near_texts, odd, rows


def parsed(*texts):
    return fingerprints.sketches([fingerprints.points(t) for t in texts])


def test_equal_parts_share_their_phrases_wherever_they_stand():
    text = near_texts(words=600)[0]
    one, shifted, half, other = parsed(text, "zz " + text, text[: len(text) // 2], near_texts(seed=9, words=600)[0])
    assert fingerprints.likeness(one, shifted) > 0.9 > 0.6 > fingerprints.likeness(one, half) > 0.3 > 0.1 > fingerprints.likeness(one, other)
    # the phrases inside a shared part are the same names at any offset
    s, t = (fingerprints.next_level(fingerprints.points(x), np.array([0]))[0] for x in (text, "q" * 7 + text[5:]))
    assert len(set(s.tolist()) & set(t.tolist())) >= 0.98 * len(set(s.tolist()))


def test_texts_parsed_together_do_not_touch():
    texts = ["", "a", "ab", "aaaaaaaa", "abab" * 50, ODD[8], *near_texts()[:5]]
    together, alone = parsed(*texts), [parsed(t)[0] for t in texts]
    assert [fingerprints.written(x) for x in together] == [fingerprints.written(x) for x in alone]
    assert fingerprints.likeness(*parsed("", "")) == 1.0 and fingerprints.likeness(*parsed("", "a")) == 0.0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_edits_with_the_next_document(spark, partitions):
    texts = [*ODD, *near_texts()]
    docs = frame(spark, texts).withColumn("doc_id", F.col("doc_id") * 17 % 1009)
    order = [r[1] or "" for r in sorted((i * 17 % 1009, t) for i, t in enumerate(texts))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = rows(fingerprints.compare_with_edits(fingerprints.with_successors(docs.repartition(5), "doc_id", "text")).orderBy("key"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found.sort(key=lambda r: r[0])
    assert len(found) == len(texts)
    for k, (_, n, digest, own, changed, near_edited, near_next) in enumerate(found):
        text, following = order[k], order[(k + 1) % len(order)]
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        a, b, c = parsed(text, other, following)
        assert (n, digest) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert (own, changed) == (fingerprints.written(a), fingerprints.written(b))
        assert (near_edited, near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))


def test_edits_of_odd_rows(spark):
    found = fingerprints.compare_with_edits(fingerprints.with_successors(odd(spark), "doc_id", "text"))
    assert found.count() == len(ODD) + 2
    assert fingerprints.compare_with_edits(fingerprints.with_successors(empty(spark), "doc_id", "text")).isEmpty()
    alone = rows(fingerprints.compare_with_edits(fingerprints.with_successors(frame(spark, ["abcd"]), "doc_id", "text")))
    assert alone[0][2] == hashlib.sha256(b"abab").hexdigest()
    assert {r[1] for r in rows(fingerprints.fingerprint(odd(spark)).where("doc_id = 6"))} == {fingerprints.written(parsed(ODD[6])[0])}


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Deal the whole by weight, cut what is above its limit, deal the rest again."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, cut = sum(sizes.values()), {}
    while True:
        rest = total - sum(cut.values())
        free = [k for k in names if k not in cut]
        share = {k: weight[k] * rest / sum(weight[x] for x in free) for k in free}
        above = {k: most * sizes[k] for k in free if share[k] > most * sizes[k]}
        if not above:
            return cut | share
        cut |= above


def test_mixing_targets_and_copies(spark):
    r = random.Random(2)
    sources = [r.choice(["a", "a", "a", "a", "b", "Z", "é", None, "tiny"]) for _ in range(3000)]
    texts = [" ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 30))) for _ in sources]
    docs = frame(spark, texts, sources=sources)
    found = mixing.mix(docs)
    assert found.columns == [*docs.columns, "size_", "source_size", "target", "copies"]
    sizes = Counter()
    for s, t in zip(sources, texts, strict=True):
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    taken, got = Counter(), {}
    for row in found.collect():
        got[row.source] = row.target
        taken[row.source] += row.size_ * row.copies
        assert row.copies <= 3 and row.size_ == len(texts[row.doc_id].split()) and row.source_size == sizes[row.source]
    assert got == pytest.approx(want) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) < 0.12 * t
    assert rows(found.select("doc_id", "copies")) == rows(mixing.mix(docs.repartition(7)).select("doc_id", "copies"))
    repeated = mixing.mixed(docs)
    assert repeated.columns == docs.columns and repeated.count() == found.agg(F.sum("copies")).first()[0]


def test_mixing_beyond_the_broadcast_bound_and_of_odd_rows(spark, monkeypatch):
    from rolemeter.operators import dimensions

    docs = frame(spark, near_texts(), sources=[["a", "b", None][i % 3] for i in range(len(near_texts()))])
    small = rows(mixing.mix(docs).select("doc_id", "source", "target", "copies"))
    monkeypatch.setattr(dimensions, "MAX_BROADCAST_ROWS", 1)
    assert rows(mixing.mix(docs).select("doc_id", "source", "target", "copies")) == small
    assert mixing.mix(odd(spark)).count() == len(ODD) + 2 and mixing.mix(empty(spark)).isEmpty()
    blank = mixing.mix(frame(spark, ["", None, " "])).select("target", "copies")
    assert set(rows(blank)) == {(0.0, 0)}


def test_packing_is_whole_and_unpadded(spark):
    texts = [*ODD, *near_texts()]
    encoder = packing.Encoder(packing.vocabulary())
    plain = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for window in (1 << 20, 3000):
        found = packing.pack(frame(spark, texts).coalesce(1), window=window).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for p in found:
            pieces[p.doc_id].append((p.start, p.length, bytes(p.ids), p.doc_tokens))
            sequences[p.sequence_id].append((p.offset, p.length))
        for i, ids in enumerate(plain):
            parts = sorted(pieces[i])
            assert np.frombuffer(b"".join(x[2] for x in parts), "<u4").tolist() == ids
            assert [x[0] for x in parts] == [sum(y[1] for y in parts[:k]) for k in range(len(parts))]
            assert {x[3] for x in parts} == {len(ids)}
        lengths = []
        for parts in sequences.values():
            parts.sort()
            assert [x[0] for x in parts] == [sum(y[1] for y in parts[:k]) for k in range(len(parts))]
            lengths.append(sum(x[1] for x in parts))
        assert sum(lengths) == sum(map(len, plain)) and all(n == 4096 or n & (n - 1) == 0 and n < 4096 for n in lengths)
        assert sum(n < 4096 for n in lengths) <= 12


def test_word_memory_gives_the_tokenizer_s_ids():
    r = random.Random(4)
    encoder = packing.Encoder(packing.vocabulary())
    encoder.words.most = encoder.letters.most = 50
    letters = "abAB éßÉŸ𝔘Ωσς.,'’-12\x1c\u2003\u200b<|"
    for _ in range(30):
        texts = ["".join(r.choice(letters) for _ in range(200)) for _ in range(20)]
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_balances_costs():
    r = random.Random(8)
    lengths = [max(1, int(r.lognormvariate(5.5, 1))) for _ in range(3000)]
    spent = defaultdict(float)
    for _, _, n, sequence, _ in packing.assign(lengths):
        spent[sequence] += packing.cost(n, 4096)
    full = sorted(spent.values())[12:]
    rest = [x for x in full if x < 1.9 * 4096]  # a document as long as a sequence costs what it costs
    assert np.std(rest) < 0.12 * np.mean(rest)


def test_packing_of_odd_and_no_rows(spark):
    found = packing.pack(odd(spark))
    assert found.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in found.where("start = 0").collect())
    assert found.where("doc_id is null").count() == 1 and packing.pack(empty(spark)).isEmpty()


def plain_near(texts, words=3, radius=2):
    prints = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split()
        shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (prints[i], find(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("radius", "tile"), [(2, 8192), (2, 3), (4, 8192), (12, 8)])
def test_near_groups_equal_all_pairs(spark, radius, tile):
    texts = [*(t if t != ODD[8] else "plain" for t in ODD), *near_texts(groups=25, words=60)]
    want = plain_near(texts, radius=radius)
    found = simhash.near_groups(frame(spark, texts), radius=radius, tile=tile)
    got = {r.key: (r.f0 & (1 << 64) - 1, r.component_id) for r in found.collect()}
    assert got == want and len({v[1] for v in got.values()}) < len(got)


def test_two_tiles_give_a_spanning_forest_of_all_links():
    r = random.Random(6)
    seeds = [r.getrandbits(64) for _ in range(8)]
    near = lambda: r.choice(seeds) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
    made = np.array(sorted({near() for _ in range(240)}), dtype=np.uint64)[r.sample(range(200), 200)].view(np.int64).reshape(-1, 1)
    one, other = made[:120], made[120:]
    apart = lambda a, b: ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count()

    def groups(links, nodes):
        parent = {int(n): int(n) for n in nodes}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        return len({find(n) for n in parent})

    nodes = [*one[:, 0], *other[:, 0]]
    for radius in (1, 2, 3):
        pairs = [(int(a), int(b)) for a in one[:, 0] for b in other[:, 0] if apart(a, b) <= radius]
        found = simhash.forest(one, other, radius, slice(0, 1), None, 0.0)
        assert set(found) <= set(pairs) and len(found) < len(nodes) and groups(found, nodes) == groups(pairs, nodes)
        pairs = [(int(a), int(b)) for a in one[:, 0] for b in one[:, 0] if apart(a, b) <= radius]
        assert groups(simhash.forest(one, None, radius, slice(0, 1), None, 0.0), one[:, 0]) == groups(pairs, one[:, 0])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200), (300, 300)]
    found = dict(rows(simhash.components(spark.createDataFrame(links, "a long, b long"))))
    assert found == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {201: 200}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_near_groups_of_odd_and_no_rows(spark):
    found = simhash.near_groups(odd(spark)).collect()
    names = {r.key: r.component_id for r in found}
    assert len(found) == len(ODD) + 2 and names[0] == names[1] == names[2] == 0 and names[6] == names[7] == 6
    assert simhash.near_groups(empty(spark)).isEmpty()
    kept = simhash.deduplicated(odd(spark), **corpus_pipeline.NEAR)
    assert kept.columns == odd(spark).columns and kept.where("doc_id in (1, 2, 7)").isEmpty() and kept.where("doc_id is null").count() == 1


def test_exact_groups_equal_sql(spark):
    texts = [*ODD, *near_texts(), *(t for t in near_texts()[:9]), "x" * 300 + "a", "x" * 300 + "b", "x" * 300 + "a", None]
    found = exact.exact_groups(frame(spark, texts))
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[t or ""].append(i)
    for row in found.collect():
        group = want[texts[row.doc_id] or ""]
        assert (row.keep_id, row.group_size, row.kept) == (max(group), len(group), row.doc_id == max(group))
        # full texts are read only where length and start are shared
        start = lambda t: (len((t or "").encode()), (t or "").encode()[: exact.PREFIX_BYTES])
        shared_start = sum(start(t) == start(texts[row.doc_id]) for t in texts) > 1
        assert (row.full_hash is not None) == shared_start
    kept = exact.deduplicated(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in want.values())


def test_exact_groups_beyond_the_broadcast_bound_and_of_odd_rows(spark, monkeypatch):
    from rolemeter.operators import dimensions

    texts = near_texts() * 2
    small = rows(exact.exact_groups(frame(spark, texts)))
    monkeypatch.setattr(dimensions, "MAX_BROADCAST_ROWS", 1)
    assert rows(exact.exact_groups(frame(spark, texts))) == small
    found = exact.exact_groups(odd(spark)).where("text = 'Repeated row of some words'").collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept, r.tied) for r in sorted(found, key=lambda r: r.doc_id)] == [(6, 7, 3, False, False)] * 2 + [(7, 7, 3, True, False)]
    twice = frame(spark, ["same"]).union(frame(spark, ["same"]))
    assert exact.deduplicated(twice).count() == 1 and exact.deduplicated(odd(spark)).columns == odd(spark).columns
    assert exact.exact_groups(empty(spark)).isEmpty() and exact.deduplicated(empty(spark)).isEmpty()


def labelled(spark, n=600):
    """Texts of random words, of which those with one of a few rude words are labelled toxic."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.25
        if toxic:
            text.insert(r.randrange(len(text)), r.choice(["zzrude", "zznasty", "zzvileness"]))
        texts.append(" ".join(text))
        labels.append((i, int(toxic)))
    return texts, labels


def test_nearest_examples_are_exact():
    texts, labels = labelled(None)
    terms = sorted({t for x in texts for w in toxicity.words(x) for t in toxicity.terms_of(w)})[:400]
    look = toxicity.Terms({t: i for i, t in enumerate(terms)})
    examples = [(i, y, look.counts(texts[i])) for i, y in labels[:400]]
    model = toxicity.Model(terms, examples, (1.0, 1.0))
    held = [(i, model.vector(c)) for i, _, c in examples if c]
    for t in texts[400:460]:
        counts = look.counts(t)
        if counts:
            q = model.vector(counts)
            plain = [(-round(sum(w * v.get(k, 0.0) for k, w in q.items()), toxicity.DECIMALS), n) for n, (_, v) in enumerate(held)]
            near = sorted(x for x in plain if x[0] < 0)
            want = [x for x in near if x[0] <= near[: toxicity.K][-1][0]]  # all as near as the last
            cosines, numbers = model.nearest(counts)
            assert numbers.tolist() == [n for _, n in want] and cosines.tolist() == pytest.approx([-s for s, _ in want])
        else:
            assert model.score(counts)[0] == model.empty_share


def test_blocks_of_any_layout_give_the_same_neighbours(monkeypatch):
    """Long lists, short lists and blocks in every proportion, texts together or alone, with many ties."""
    r = random.Random(3)
    terms = [f"t{i:03}".encode() for i in range(120)]
    counts = [{r.choice([r.randrange(120), r.randrange(8)]): r.randint(1, 3) for _ in range(r.randint(0, 40))} for _ in range(300)]
    examples = [(f"id{i}", r.randint(0, 1), c) for i, c in enumerate([*counts, *counts[:40]])]
    asked = [{r.choice([r.randrange(120), r.randrange(8)]): r.randint(1, 3) for _ in range(r.randint(1, 50))} for _ in range(50)] + counts[:20]
    found = []
    for lists, share, block, together in ((768, 1 / 64, 64, 64), (0, 0.0, 16, 7), (120, 0.0, 16, 3), (5, 0.1, 400, 1)):
        for name, value in (("LONG_LISTS", lists), ("LONG_SHARE", share), ("BLOCK", block), ("TOGETHER", together)):
            monkeypatch.setattr(toxicity, name, value)
        model = toxicity.Model(terms, examples, (1.0, 1.0), {1, 2, 3})
        found.append([(round(s, 8), e) for s, e, _ in model.scores(asked)])
    assert all(x == found[0] for x in found) and any(len(e) > toxicity.K for _, e in found[0])


def test_ids_of_text_serve_as_evidence(spark):
    texts, labels = labelled(spark, 200)
    docs = frame(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    model = toxicity.learn(docs, spark.createDataFrame([(f"d{i}", y) for i, y in labels], "doc_id string, toxic int"))
    found = toxicity.score(docs, model)
    assert dict(found.dtypes)["evidence"] == "array<string>" and found.count() == len(texts)


def test_toxicity_on_rows_held_out(spark):
    texts, labels = labelled(spark)
    docs = frame(spark, [*texts, None, ""])
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, given)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(found) == len(texts) + 2 and all(0 <= r.score <= 1 for r in found.values())
    assert all((found[i].score >= toxicity.CUT) == bool(y) for i, y in held)
    # labels of rows held out change nothing
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels], "doc_id long, toxic int")
    again = toxicity.score(docs, toxicity.learn(docs, flipped))
    assert {r.doc_id: r.score for r in again.collect()} == {i: r.score for i, r in found.items()}
    toxic = next(i for i, y in held if y)
    assert found[toxic].evidence and all(dict(labels)[i] == 1 for i in found[toxic].evidence[:3])
    clean = toxicity.clean(docs, given)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in found.items() if r.score < toxicity.CUT}


def test_toxicity_of_odd_rows_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(odd(spark), none)
    assert {r.score for r in toxicity.score(odd(spark), model).collect()} == {0.0}
    strange = spark.createDataFrame([(0, None), (None, 1), (3, 1), (3, 0), (999, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd(spark), toxicity.learn(odd(spark), strange)).count() == len(ODD) + 2
    assert toxicity.score(empty(spark), toxicity.learn(empty(spark), strange)).isEmpty()
    assert toxicity.score(odd(spark), model, keep=("doc_id", "Score")).columns == ["doc_id", "Score", "score_", "evidence", "cosines"]


@pytest.mark.parametrize("name", ["op5_mixing", "op8_exact"])
def test_queries_with_sql(spark, sf_dir, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = db.execute(ORACLE[name]).df()
    got = REGISTRY[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    got, want = (x[order].sort_values("doc_id", ignore_index=True) for x in (got, want))
    assert [str(t) for t in got.dtypes] == [str(t) for t in want.dtypes] and (got == want).all(axis=None)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - {"op11_filter_audit"}))
def test_queries_give_every_row(spark, sf_dir, name):
    found = REGISTRY[name](spark, sf_dir)
    if name == "op10_urls":
        assert found.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    else:
        assert found.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline_stages(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents")
    by = dict(corpus_pipeline.STAGES)
    clean = by["toxicity"](spark, docs, sf_dir).persist()
    scored = {r.doc_id: r.score for r in REGISTRY["op9_toxicity"](spark, sf_dir).collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, s in scored.items() if s < 0.7}
    single = by["exact"](spark, clean, sf_dir).persist()
    texts = {r.doc_id: r.text for r in clean.collect()}
    last = {t: i for i, t in sorted(texts.items())}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == set(last.values())
    apart = by["near"](spark, single, sf_dir).persist()
    groups = {r.key: r.component_id for r in simhash.near_groups(single, **corpus_pipeline.NEAR).collect()}
    assert apart.columns == docs.columns and {r.doc_id for r in apart.collect()} == set(groups.values())
    mixed = by["mixing"](spark, apart, sf_dir).persist()
    times = {r.doc_id: r.copies for r in mixing.mix(apart).collect()}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n})
    packed = by["packing"](spark, mixed, sf_dir)
    assert packed.where("start = 0").count() == mixed.count()
    assert corpus_pipeline.run(spark, sf_dir).agg(F.sum("length")).first() == packed.agg(F.sum("length")).first()


def test_odd_documents_go_through_every_stage(spark, sf_dir):
    for docs in (odd(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, sf_dir)
            assert kept.columns == docs.columns, name
            docs = kept.persist()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.where("start = 0").count() == docs.count()


@pytest.mark.parametrize(("parts", "radius"), [(2, 20), (4, 42)])
def test_wide_fingerprints_equal_all_pairs(spark, parts, radius):
    texts = [*near_texts(groups=25, words=80), "", "one", "two words"]
    hashes = [simhash.shingle_hashes(t, 5) for t in texts]
    prints = [np.array(simhash.fingerprint(h, parts), dtype=np.int64).view(np.uint64) for h in hashes]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = len(hashes[i]), len(hashes[j])
            if np.bitwise_count(prints[i] ^ prints[j]).sum() <= radius and min(a, b) >= 0.8 * max(a, b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    found = simhash.near_groups(frame(spark, texts), words=5, parts=parts, radius=radius, ratio=0.8, tile=16)
    assert {r.key: r.component_id for r in found.collect()} == {i: find(i) for i in range(len(texts))}


def test_repeated_passages_weigh_once_in_the_near_stage(spark):
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, line, copied = text(34), text(20), text(400)
    texts = [
        f"{text(504)} {' '.join([passage] * 50)}", f"{text(504)} {' '.join([passage] * 50)}",
        f"{copied} {' '.join([line] * 2)}", f"{copied} {' '.join([line] * 20)}",
    ]
    kept = simhash.deduplicated(frame(spark, texts), **corpus_pipeline.NEAR)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2}


@pytest.mark.parametrize("tiles", [{}, {"tile": 16, "set_tile": 2000}])
def test_near_stage_equals_all_pairs_by_similarity(spark, tiles):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = ["", "one", "two words", "a b c d e f g h", "a b c d e f g h i"]
    for n in (60, 150, 400):
        for share in (0.02, 0.05, 0.09, 0.11, 0.13, 0.17, 0.22, 0.3):
            for _ in range(3):
                base = [word() for _ in range(n)]
                changed = int(n * share)
                texts += [" ".join(base), " ".join(base[: n - changed] + [word() for _ in range(changed)])]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                parent[i] = min(parent[i], parent[j])
    found = {x.key: x.component_id for x in simhash.near_groups(frame(spark, texts), **corpus_pipeline.NEAR, **tiles).collect()}
    assert found == dict(enumerate(parent)) and len(set(parent)) < len(texts) - 20


def test_rare_toxic_text_is_known_by_its_labelled_copy(spark):
    texts, labels = labelled(spark)
    texts, labels = list(texts), list(labels)
    rare = "qqodd sentence nobody else would ever write about zzunseen matters"
    ids = {v: next(i for i in range(len(texts), 5000) if (zlib.crc32(str(i).encode()) % 3 == 1) == v) for v in (True, False)}
    texts += ["plain"] * (max(ids.values()) + 1 - len(texts))
    texts[ids[True]] = texts[ids[False]] = rare
    labels.append((ids[False], 1))
    docs = frame(spark, texts)
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}[ids[True]]
    assert found.evidence[0] == ids[False] and found.cosines[0] == 1.0 and found.score >= toxicity.CUT


def test_small_batches_bound_what_a_task_gets_and_leave_the_setting(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda: max(r.n for r in spark.createDataFrame([("x" * 1000,)] * 800, "t string").coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect())
    with shared.small_batches(spark, 50_000):
        assert sizes() < 100
    assert sizes() == 800 and spark.conf.get(name, None) is None
    spark.conf.set(name, "70000")
    with shared.small_batches(spark, 50_000):
        pass
    assert spark.conf.get(name) == "70000"
    spark.conf.unset(name)


def test_every_pair_of_tiles_meets_once_and_no_key_holds_many(spark):
    made = spark.createDataFrame([(b, c, [b, c]) for b, n in ((0, 1), (1, 60), (2, 9)) for c in range(n)], "band long, chunk long, items array<long>")
    chunks = made.groupBy("band").agg(F.count(F.lit(1)).alias("chunks"))
    probes = lambda t: t.withColumn("probe", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    pairs = simhash.tile_pairs(made, chunks, probes, ["items"])
    got = Counter((*r.own_items, *r["items"]) for r in pairs.collect())
    have = [tuple(r["items"]) for r in made.collect()]
    want = {(*x, *y) for x in have for y in have if (x[0] == y[0] and x[1] <= y[1]) or x[0] + 1 == y[0]}
    assert set(got) == want and set(got.values()) == {1}
    assert max(r["count"] for r in pairs.groupBy("own", "probe", "own_share", "share").count().collect()) <= simhash.SHARE**2


def test_a_block_of_comparisons_is_bounded_where_ranges_widen():
    made = np.random.default_rng(2)
    one, other = (np.column_stack([made.integers(-(2**62), 2**62, (4096, 5)), np.full(4096, n)]) for n in (1000, 1100))
    one[0, 5], other[0, 5] = 800, 1000
    other[7, 1:5] = one[5, 1:5]
    tracemalloc.start()
    found = [(i.tolist(), j.tolist()) for i, j in simhash.near_pairs(one, other, 72, slice(1, 5), 5, 0.8)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [([5], [7])] and peak < 8e6


def test_scores_hold_the_counts_of_few_texts_at_once(monkeypatch):
    r = random.Random(8)
    terms = [f"w{i}".encode() for i in range(60)]
    asked = [{r.randrange(60): r.randint(1, 4) for _ in range(r.choice([0, 3, 9]))} for _ in range(3 * toxicity.TOGETHER + 5)]
    model = toxicity.Model(terms, [(i, i % 2, c) for i, c in enumerate(asked[:40])], (1.0, 1.0))
    taken, judged, nearest = [], [], toxicity.Model.nearest_of

    def given():
        for c in asked:
            taken.append(bool(c))
            yield c

    def seen(self, vectors, *rest):
        judged.append(len(vectors))
        assert sum(taken) - sum(judged) < toxicity.TOGETHER
        return nearest(self, vectors, *rest)

    monkeypatch.setattr(toxicity.Model, "nearest_of", seen)
    found = model.scores(given())
    monkeypatch.undo()
    assert sum(judged) == sum(map(bool, asked)) and max(judged) == toxicity.TOGETHER
    assert [(round(s, 8), e) for s, e, _ in found] == [(round(s, 8), e) for s, e, _ in map(model.score, asked)]
    assert list(shared.slices(pa.array(["abc", None, "d", "efgh"]), 4)) == [(0, 3), (3, 1)]


def test_words_looked_up_together_are_counted_as_those_of_each_text(monkeypatch):
    r = random.Random(12)
    letters = ["a", "B", "ab", "abc", "abcd", "abcde", "abcdefg", "İ", "Σ", "ß", " ", " ", "*", "\x1c", "\u2003", "7", "\n", "𝔘"]
    texts = [None, "", " \n ", *("".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(300))]
    found = sorted({t for x in texts for w in toxicity.words(x or "") for t in toxicity.terms_of(w)})
    for terms in (found, found[::3], [t for t in found if b"*" in t], []):
        look = toxicity.Terms({t: i for i, t in enumerate(terms)})
        want = [sorted(look.counts(x or "").items()) for x in texts]
        for size in (1, 500, 1 << 20):
            monkeypatch.setattr(toxicity, "READ", size)
            for begin in (0, 2):  # of a slice, too
                got = [list(zip(*c.tolist(), strict=True)) for c in toxicity.count_arrays(look, pa.array(texts, pa.string()).slice(begin))]
                assert got == want[begin:]
