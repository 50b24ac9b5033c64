"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled training rows (`max_examples` of each label, by a hash of the id) gives
the terms, the examples and the votes:

* of near copies in the sample, found by the least hash of their five-word shingles, one is used;
* terms are all words of the examples. Besides there are marks: words and first 4, 5 and 6 bytes of
  words, the `max_terms` that mark the label 1 best by the likelihood ratio, are at least four times
  as frequent under it, and whose ratio chance would not give even once among all terms of the sample;
* a text is its TF-IDF vector of length one, with the document frequencies of all documents. In a
  text that has marks they make up MARKED of the square of the length, however long the text is; in
  one without, the words alone tell how near it is. The inverted index holds for each term the
  examples by number; long lists are in blocks, with the largest weight of each block;
* a text reads its short lists, and of the long ones the blocks whose bound reaches the cosine of the
  `k`-th nearest example found so far, the block of the largest bound first. The outcome is exact;
* the nearest examples, with all that are as near as the `k`-th, vote by cosine, less the farther they are behind the nearest. A vote is
  weighted so that the sample stands for all labelled rows, and the share of the label 1 among all
  counts as one further, weak vote. A text without any of the terms gets the share of the label 1
  among examples without any.

The model is bounded by its parameters, so it can be sent to every task. Scoring is a projection.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType

from rolemeter.llm.shared import checkpointed, fresh, kind, slices, small_batches, table

MAX_EXAMPLES, MAX_TERMS, LIFT = 2048, 512, 4.0
#: Twice the log likelihood ratio; beyond it lies 4e-8 of what chance gives one term.
LEAST_RATIO = 30.0
SHINGLE = 5
PREFIXES = (4, 5, 6)
K, BLOCK, WEAK_VOTE, CUT = 15, 64, 0.25, 0.7
#: Share of the marks in a marked text; how votes fall with the cosine against the nearest.
MARKED, SHARPNESS = 0.9, 8
#: At most so many lists are long, those of terms in more than this share of the examples, for which a block read
#: whole costs less than its entries one by one; texts compared together.
LONG_LISTS, LONG_SHARE, TOGETHER = 512, 1 / 20, 32
#: Sums of cosines are compared after rounding, so their order cannot depend on the order of adding.
DECIMALS = 9
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
REMEMBERED = 200_000
FLUSH = 300_000
#: Bytes of text that a Python task of `learn` is sent, and one of `score` takes up and sends back, at once.
SENT = 8 << 20
#: Bytes of text whose words are looked up together.
READ = 1 << 21


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(WORD_BYTES).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked as such."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def shingle_mark(text: str) -> int:
    """The least hash of all runs of five words; near copies mostly share it."""
    w = words(text)
    return min(xxhash.xxh64_intdigest(b" ".join(w[i : i + SHINGLE])) for i in range(max(1, len(w) - SHINGLE + 1))) >> 1


class Terms(dict):
    """The known terms of a word, remembered for a bounded number of words."""

    def __init__(self, known: dict[bytes, int]) -> None:
        super().__init__()
        self.known = known

    def __reduce__(self):
        return Terms, (self.known,)

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        found = tuple(self.known[t] for t in terms_of(word) if t in self.known)
        self[word] = found
        return found

    def counts(self, text: str) -> dict[int, int]:
        """How often each known term occurs in a text."""
        out: dict[int, int] = {}
        for word, n in Counter(words(text)).items():
            for t in self[word]:
                out[t] = out.get(t, 0) + n
        return out

    @functools.cached_property
    def sets(self) -> list[tuple[int | None, pa.Array, np.ndarray]]:
        """Known words, then known beginnings of each length, with their numbers."""
        out = []
        for n in (None, *PREFIXES):
            own = [t for t in self.known if (len(t) == n + 1 if n else True) and t.endswith(b"*") == bool(n)]
            out.append((n, pa.array([t[:n] for t in own], pa.binary()), np.array([self.known[t] for t in own], dtype=np.int64)))
        return [x for x in out if len(x[1])]

    def counted(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For consecutive texts: where the terms of each begin, and of the last end; the terms in order; how often each occurs.

        The words of some megabytes of text are looked up together.
        """
        width = max(1, len(self.known))
        for begin, n in slices(texts, READ):
            plain = [t.lower().encode().translate(WORD_BYTES) for t in texts.slice(begin, n).fill_null("").to_pylist()]
            pieces = pc.ascii_split_whitespace(pa.array(plain, pa.string()))
            offsets = pieces.offsets.to_numpy()
            found = pieces.flatten().cast(pa.binary())
            keys = [np.zeros(0, dtype=np.int64)]
            for size, known, numbers in self.sets:
                at = pc.index_in(pc.binary_slice(found, 0, size) if size else found, value_set=known)
                if size:  # a whole word is no beginning
                    at = pc.if_else(pc.greater(pc.binary_length(found), size), at, None)
                place = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                keys.append((np.searchsorted(offsets, place, "right") - 1) * width + numbers[at.drop_null().to_numpy()])
            keys, times = np.unique(np.concatenate(keys), return_counts=True)
            yield np.searchsorted(keys, np.arange(n + 1) * width), keys % width, times


def _arrays(counts: dict[int, int] | np.ndarray) -> np.ndarray:
    """Terms in order and their counts as two rows; an array has them already."""
    if isinstance(counts, dict):
        return np.array(sorted(counts.items()), dtype=np.int64).reshape(-1, 2).T
    return counts


def count_arrays(look: Terms, texts: pa.Array) -> Iterator[np.ndarray]:
    """The known terms of each text and their counts, as two rows."""
    for starts, terms, times in look.counted(texts):
        both = np.stack([terms, times])
        for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield both[:, begin:end]


class Model:
    """The index of the examples, and how they vote. Without examples every score is 0."""

    def __init__(
        self, terms: list[bytes], examples: list[tuple[int, int, dict[int, int]]], weights: tuple[float, float],
        marks: set[int] = frozenset(), seen_in: tuple[int, dict[int, int]] | None = None, id_type: DataType = LongType(),
    ) -> None:
        """`examples` are (id, label, term counts), `weights` what one of each label stands for, `id_type` the ids' type.

        `marks` are numbers of terms, `seen_in` the documents in all and those with each term.
        """
        self.terms = {t: i for i, t in enumerate(terms)}
        self.weights, self.id_type = weights, id_type
        examples = [(i, y, _arrays(c)) for i, y, c in examples]
        held = sorted((e for e in examples if e[2].size), key=lambda e: e[0])
        own = [e[2][0] for e in held]
        if seen_in is None:
            seen_in = len(examples), np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *own]), minlength=len(terms))
        self.idf = np.log((seen_in[0] + 1) / (seen_in[1] + 1)) + 1
        self.marked = np.zeros(len(terms), dtype=bool)
        self.marked[list(marks)] = True
        self.ids = [e[0] for e in held]
        self.labels = np.array([e[1] for e in held], dtype=np.int64)
        rest = [e[1] for e in examples if not e[2].size]
        self.share = self._share([e[1] for e in examples], 0.0)
        self.empty_share = self._share(rest, self.share)
        blocks = -(-len(held) // BLOCK)
        found = self.weighted_of([e[2] for e in held])
        of = np.concatenate([np.zeros(0, dtype=np.int64), *(t for t, _ in found)])
        numbers = np.repeat(np.arange(len(held)), [len(t) for t, _ in found])
        impacts = np.concatenate([np.zeros(0), *(w for _, w in found)])
        # long lists lie in blocks, laid out whole, with the largest weight of each
        sizes = np.bincount(of, minlength=len(terms))
        self.long = np.sort(np.argsort(-sizes, kind="stable")[:LONG_LISTS])
        self.long = self.long[sizes[self.long] > len(held) * LONG_SHARE]
        self.long_of = np.full(len(terms), -1, dtype=np.int64)
        self.long_of[self.long] = np.arange(len(self.long))
        in_long = self.long_of[of] >= 0
        self.dense = np.zeros((blocks, len(self.long), BLOCK))
        self.dense[numbers[in_long] // BLOCK, self.long_of[of[in_long]], numbers[in_long] % BLOCK] = impacts[in_long]
        self.bounds = np.ascontiguousarray(self.dense.max(axis=2, initial=0.0).T)
        # short lists, by term
        order = np.lexsort((numbers[~in_long], of[~in_long]))
        self.numbers, self.impacts = numbers[~in_long][order], impacts[~in_long][order]
        self.starts = np.searchsorted(of[~in_long][order], np.arange(len(terms) + 1))
        self.look = Terms(self.terms)

    def _share(self, labels: list[int], none: float) -> float:
        ones, zeros = sum(labels) * self.weights[1], (len(labels) - sum(labels)) * self.weights[0]
        return ones / (ones + zeros) if labels and ones + zeros else none

    def weighted_of(self, counts: list[dict[int, int] | np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The terms of each text in order, and its TF-IDF vector of length one over them."""
        if not counts:
            return []
        arrays = [_arrays(c) for c in counts]
        sizes = np.array([a.shape[1] for a in arrays])
        terms, numbers = np.concatenate(arrays, axis=1)
        weights = (1 + np.log(numbers)) * self.idf[terms]
        part = 2 * np.repeat(np.arange(len(arrays)), sizes) + self.marked[terms]
        squares = np.bincount(part, weights**2, 2 * len(arrays)).reshape(-1, 2)
        both = (squares > 0).all(axis=1, keepdims=True)
        shares = np.where(both, (1 - MARKED, MARKED), 1.0)
        weights *= np.sqrt(shares / np.where(squares > 0, squares, 1.0)).ravel()[part]
        ends = np.cumsum(sizes)[:-1]
        return list(zip(np.split(terms, ends), np.split(weights, ends), strict=True))

    def weighted(self, counts: dict[int, int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.weighted_of([counts])[0]

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        terms, weights = self.weighted(counts)
        return dict(zip(terms.tolist(), weights.tolist(), strict=True))

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the cosines and numbers of its k nearest examples that share a term, and of those as near as the k-th.

        The short lists, of terms in few examples, are read whole. With them and the largest weights
        of the long lists every block has a bound; each text first reads its best block, then every
        block whose bound reaches the k-th cosine found there. Texts that read a block do so together.
        """
        n, blocks = len(self.ids), self.bounds.shape[1]
        if not n:
            return [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(vectors)
        wide = blocks * BLOCK
        text = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        terms, weights = (np.concatenate(x) for x in zip(*vectors, strict=True))
        column = self.long_of[terms]
        heavy = np.zeros((len(vectors), len(self.long)))
        heavy[text[column >= 0], column[column >= 0]] = weights[column >= 0]
        text, terms, weights = text[column < 0], terms[column < 0], weights[column < 0]
        sizes = self.starts[terms + 1] - self.starts[terms]
        entries = np.repeat(self.starts[terms] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        places = self.numbers[entries] + np.repeat(text * wide, sizes)
        gains = self.impacts[entries] * np.repeat(weights, sizes)
        shape = (len(vectors), blocks, BLOCK)
        light = np.bincount(places, gains, len(vectors) * wide).reshape(shape)
        bound = light.max(axis=2) + heavy @ self.bounds
        scores = np.zeros(shape)

        def read(texts: np.ndarray, block: int) -> None:
            scores[texts, block] = (light[texts, block] + heavy[texts] @ self.dense[block]).round(DECIMALS)

        best = bound.argmax(axis=1)
        for block in np.unique(best).tolist():
            read(np.flatnonzero(best == block), block)
        found = scores[np.arange(len(vectors)), best]
        least = np.sort(found, axis=1)[:, -k] if k <= BLOCK else np.zeros(len(vectors))
        for block in range(blocks):
            reach = (bound[:, block] > 0) & (bound[:, block] >= least - 10.0**-DECIMALS) & (best != block)
            if reach.any():
                read(np.flatnonzero(reach), block)
        out = []
        for row in scores.reshape(len(vectors), wide):
            limit = np.partition(row, -k)[-k] if wide > k else 0.0
            hit = np.flatnonzero((row >= limit) & (row > 0))
            order = np.lexsort((hit, -row[hit]))
            out.append((row[hit][order], hit[order]))
        return out

    def nearest(self, counts: dict[int, int], k: int = K) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([self.weighted(counts)], k)[0]

    def scores(self, counts: Iterable[dict[int, int] | np.ndarray]) -> list[tuple[float, list, list[float]]]:
        """For each text the score, the ids of the nearest examples and their cosines. Counts are held of TOGETHER texts at once."""
        out: list = []
        filled: list[tuple[int, np.ndarray]] = []

        def vote() -> None:
            for (i, _), (cosines, numbers) in zip(filled, self.nearest_of(self.weighted_of([c for _, c in filled])), strict=True):
                labels = self.labels[numbers]
                votes = cosines * (cosines / max(cosines, default=1.0)) ** SHARPNESS * np.where(labels == 1, self.weights[1], self.weights[0])
                share = float((votes[labels == 1].sum() + WEAK_VOTE * self.share) / (votes.sum() + WEAK_VOTE))
                out[i] = share, [self.ids[x] for x in numbers.tolist()], cosines.tolist()
            filled.clear()

        for i, c in enumerate(counts):
            out.append((self.empty_share, [], []))
            c = _arrays(c)
            if c.size:
                filled.append((i, c))
            if len(filled) == TOGETHER:
                vote()
        if filled:
            vote()
        return out

    def score(self, counts: dict[int, int]) -> tuple[float, list, list[float]]:
        return self.scores([counts])[0]


def training_rows(labels: DataFrame, key: str, label: str, max_examples: int) -> tuple[DataFrame, dict[int, int]]:
    """Ids and labels of the sample, and how many rows of each label there are to learn from.

    Rows held out (CRC-32 of the id as text leaves 1 when divided by 3), without a label or without
    an id are no training rows; of several labels of one id the largest counts.
    """
    rows = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1))
        .groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    )
    rows = checkpointed(rows)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = [rows.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(max_examples) for v in (0, 1)]
    return parts[0].union(parts[1]), counts


def term_counts(examples: DataFrame) -> DataFrame:
    """Documents of either label with each term; partial sums leave a task whenever it holds many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            terms = list(found[0].keys() | found[1].keys())
            made = pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.binary()), pa.array([found[0][t] for t in terms], pa.int64()), pa.array([found[1][t] for t in terms], pa.int64())],
                names=["term", "zeros", "ones"],
            )
            for f in found:
                f.clear()
            return made

        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label].update({t for w in set(words(body)) for t in terms_of(w)})
                if len(found[0]) + len(found[1]) > FLUSH:
                    yield out()
        yield out()

    return examples.select("label", "body").mapInArrow(run, "term binary, zeros bigint, ones bigint").groupBy("term").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def without_copies(examples: DataFrame) -> DataFrame:
    """Of the examples of one label and mark, the one with the smallest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([shingle_mark(b.as_py()) for b in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=["key", "label", "body", "mark"])

    marked = examples.mapInArrow(run, f"key {kind(examples, 'key')}, label int, body string, mark bigint")
    return marked.groupBy("label", "mark").agg(F.min_by("body", F.struct("key", F.xxhash64("body"))).alias("body"), F.min("key").alias("key")).select("key", "label", "body")


def likelihood_ratio(ones: Column, zeros: Column, all_ones: int, all_zeros: int) -> Column:
    """Twice the log likelihood ratio of a term's counts under the labels, against one common share."""
    share = (ones + zeros) / (all_ones + all_zeros)

    def part(seen: Column, whole: int) -> Column:
        missing = whole - seen
        return F.when(seen > 0, seen * F.log(seen / (whole * share))).otherwise(0.0) + F.when(
            missing > 0, missing * F.log(missing / (whole * (1 - share)))
        ).otherwise(0.0)

    return 2 * (part(ones, all_ones) + part(zeros, all_zeros))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Model:
    """The model. The driver receives the words and vectors of the sample, no texts.

    Ids may be of any type. Documents of one id are examples with that id's label, one each unless they are near
    copies; an id of labels without a document is none. Ties decide nothing: of near copies the
    one with the smallest id serves, and all examples as near as the last that votes vote too.
    """
    with small_batches(docs.sparkSession, SENT):
        sample, counts = training_rows(labels, key, label, max_examples)
        bodies = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
        # at most twice `max_examples` ids
        examples = checkpointed(without_copies(bodies.join(F.broadcast(sample), "key").select("key", "label", "body")))
        sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
        zeros, ones = sizes.get(0, 0), sizes.get(1, 0)
        if not zeros + ones:
            return Model([], [], (1.0, 1.0), id_type=docs.schema[key].dataType)
        a, b = F.col("ones"), F.col("zeros")
        share_one, share_zero = (a + 0.5) / (ones + 1), (b + 0.5) / (zeros + 1)
        ratio = F.round(likelihood_ratio(a, b, ones, zeros), 6)
        counted = checkpointed(term_counts(examples))
        chosen = (
            counted.where(share_one >= LIFT * share_zero).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
            .orderBy(F.desc("ratio"), "term").limit(max_terms).select("term").collect()
        )
        marked = {bytes(r["term"]) for r in chosen}
        # beginnings end in a star, which no word holds
        terms = sorted(marked.union(counted.where(~F.endswith("term", F.lit(b"*"))).select("term").toArrow()["term"].to_pylist()))
        known = {t: i for i, t in enumerate(terms)}

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = Terms(sent.value)
            for batch in batches:
                found = [c.astype("<i8").tobytes() for c in count_arrays(look, batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["key", "label", "counts"])

        sent = docs.sparkSession.sparkContext.broadcast(known)

        def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look, found, rows = Terms(sent.value), np.zeros(len(sent.value) + 1, dtype=np.int64), 0
            for batch in batches:
                rows += batch.num_rows
                for _, has, _ in look.counted(batch.column(0)):
                    found += np.bincount(has, minlength=len(found))
            # the last place counts the documents
            found[-1] = rows
            there = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(found[there])], names=["term", "documents"])

        counted = bodies.select("body").mapInArrow(frequencies, "term bigint, documents bigint").groupBy("term").agg(F.sum("documents").alias("n")).toArrow()
        seen = np.zeros(len(terms) + 1, dtype=np.int64)
        seen[counted["term"].to_numpy()] = counted["n"].to_numpy()
        rows = examples.mapInArrow(vectors, f"key {kind(examples, 'key')}, label int, counts binary").toArrow()
        held = sorted(zip(*(rows[c].to_pylist() for c in ("key", "label", "counts")), strict=True))
        held = [(k, v, np.frombuffer(c, dtype="<i8").reshape(2, -1)) for k, v, c in held]
        # what one example of a label stands for, in units of one of the label 1
        stands = [counts.get(v, 0) / max(sizes.get(v, 0), 1) for v in (0, 1)]
        unit = stands[1] or stands[0] or 1.0
        return Model(terms, held, (stands[0] / unit, stands[1] / unit), {known[t] for t in marked}, (int(seen[-1]), seen[:-1]), docs.schema[key].dataType)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, `score`, `evidence` (ids of the nearest examples) and their `cosines`.

    A null or empty text has none of the terms. Each of repeated rows is scored; no rows give none.
    """
    body, out, evidence, cosines = fresh(keep, "body", "score", "evidence", "cosines")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    width = len(keep)
    # a kept text is not sent twice
    place = keep.index(text) if text in keep else width
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        look = judge.look
        for batch in batches:
            for begin, n in slices(batch.column(place), SENT):
                part = batch.slice(begin, n)
                found = judge.scores(count_arrays(look, part.column(place)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array([round(f[0], DECIMALS) for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(ids)), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
                    names=[*keep, out, evidence, cosines],
                )
        look.clear()  # the worker outlives the task
        pa.default_memory_pool().release_unused()

    ids = to_arrow_type(model.id_type)
    schema = ", ".join([*(f"`{c}` {kind(docs, c)}" for c in keep), f"`{out}` double", f"`{evidence}` array<{model.id_type.simpleString()}>", f"`{cosines}` array<double>"])
    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", cut: float = CUT) -> DataFrame:
    """The documents whose score is below `cut`, with the columns they had."""
    model = learn(docs, labels, text, key)
    scored = score(docs, model, text, tuple(docs.columns))
    return scored.where(F.col(scored.columns[-3]) < cut).select(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.col("evidence"))
