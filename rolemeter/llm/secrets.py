"""Secret scan: fixed patterns, and a battery of randomness tests with a controlled share of false finds.

Runs of 20 or more characters of a code alphabet are candidates, whole, without their marks, or by
the parts between them. For each the smallest alphabet
that holds it is inferred (digits, hex, base32, base36, base62, base64 ...), and

* chi-squared over that alphabet and the number of runs of character classes are each compared with
  what prose and identifiers give (repeated letters, few changes of class). Both p-values depend on
  the length: a short run cannot be convincing. Fisher's method combines them;
* chi-squared, runs and lag-1 serial correlation are also compared with a uniform random string. A
  candidate that a random string would hardly give (a sequence, a repeated pattern) is out.

The p-values of the whole corpus then go through the Benjamini-Hochberg step-up, separately for
each length band, so short candidates do not profit from long ones. The step-up needs only the
number of candidates per band and rounded p-value, a table of bounded size.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.llm.shared import checkpointed, fresh, kind, table

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

LEAST_RUN = 20
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}")
PART = re.compile("[A-Za-z0-9]+")
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RUN_BYTES = bytes(120 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_-") else 32 for c in range(256))
HEX_BYTES = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))

DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: By size; the first that holds a run is its encoding.
ENCODINGS = (
    ("decimal", DIGITS), ("hex", DIGITS + "abcdef"), ("hex_upper", DIGITS + "ABCDEF"), ("lower", LETTERS), ("upper", LETTERS.upper()),
    ("base32", LETTERS.upper() + "234567"), ("base36", DIGITS + LETTERS), ("base36_upper", DIGITS + LETTERS.upper()),
    ("letters", LETTERS.upper() + LETTERS), ("base62", LETTERS.upper() + LETTERS + DIGITS),
    ("base64", LETTERS.upper() + LETTERS + DIGITS + "+/"), ("base64url", LETTERS.upper() + LETTERS + DIGITS + "-_"),
    ("mixed", LETTERS.upper() + LETTERS + DIGITS + "+/-_"),
)
HOLDS = [(name, frozenset(a), np.array([a.find(chr(c)) for c in range(128)], dtype=np.int16), len(a)) for name, a in ENCODINGS]
CLASS = np.array([0 if chr(c).islower() else 1 if chr(c).isupper() else 2 if chr(c).isdigit() else 3 for c in range(128)], dtype=np.int8)



def _changes(alphabet: str) -> float:
    """How often neighbours of a random string are of different class, marks left out."""
    counts = np.bincount(CLASS[[ord(c) for c in alphabet]], minlength=4)[:3]
    return float(1 - ((counts / counts.sum()) ** 2).sum())


CHANGES = {name: _changes(alphabet) for name, alphabet in ENCODINGS}

#: Chance that two letters of prose are equal, and the least excess over a uniform alphabet.
PROSE_REPEAT, LEAST_EXCESS = 0.0667, 0.6
#: Share of neighbours of different class in words, identifiers and paths.
PROSE_CHANGES = 0.1
#: A random string exceeds this many standard deviations in one test of 10,000.
CONFORM = 3.9
#: Upper ends of the length bands.
BANDS = (31, 47, 95)
MOST_BIN = 400


def normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def binomial_at_least(n: int, p: float, k: int) -> float:
    """P(X >= k), summed in logarithms from the term at k; terms fall fast above the mean."""
    if k <= n * p:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = 1.0
    for i in range(k, n):
        term *= (n - i) / (i + 1) * p / (1 - p)
        total += term
        if term < 1e-12 * total:
            break
    return min(1.0, math.exp(log_term) * total)


def battery(run: str) -> tuple[str, float]:
    """The inferred encoding and the p-value of a string: small if prose would hardly look like it.

    1.0 for a run that a random string of its encoding would hardly give either.
    """
    run = run.rstrip("=")
    chars = set(run)
    name, _, places, size = next(x for x in HOLDS if chars <= x[1])
    codes = np.frombuffer(run.encode(), dtype=np.uint8)
    symbols, n = places[codes], len(codes)
    counts = np.bincount(symbols, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    classes = CLASS[codes]
    classes = classes[classes < 3]  # marks part the words of a path, which are no change of class
    changes = int((classes[1:] != classes[:-1]).sum())

    # against a uniform random string
    free, steps = size - 1, max(len(classes) - 1, 1)
    rate = CHANGES[name]
    z_runs = (changes - steps * rate) / math.sqrt(steps * rate * (1 - rate)) if rate else 0.0
    centred = symbols - symbols.mean()
    power = float((centred * centred).sum())
    z_serial = float((centred[1:] * centred[:-1]).sum()) / power * math.sqrt(n) if power else math.sqrt(n)
    # chi-squared has a long upper tail at small n: the cube-root transform makes it near normal
    z_chi = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)) if free else 0.0
    if max(abs(z_runs), abs(z_serial), z_chi) > CONFORM:
        return name, 1.0

    # against prose
    excess = max(size * PROSE_REPEAT - 1, LEAST_EXCESS) * n
    p_chi = normal_below((chi - free - excess) / math.sqrt(2 * free + 4 * excess))
    p_runs = binomial_at_least(steps, PROSE_CHANGES, changes)
    both = -math.log(max(p_chi, 1e-300)) - math.log(max(p_runs, 1e-300))
    return name, min(1.0, math.exp(-both) * (1 + both))


def band(length: int) -> int:
    return sum(length > b for b in BANDS)


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns; the byte tests only save time."""
    found = []
    low = data.translate(LOWER_BYTES)
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"x" * LEAST["hex"] in data.translate(HEX_BYTES):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


def tested(run: str) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, p-value) of what a run is taken for: the whole, or its parts between marks.

    A run with marks in it may be a code that has them, one written in groups (its marks are then
    left out, as in a UUID), or a code behind the words of a path. All are tested, and the p-values multiplied by
    the number of tests; where a part is the least likely, the parts are the candidates.
    """
    body = run.rstrip("=")
    parts = [m.span() for m in PART.finditer(body)]
    if len(parts) < 2 and parts == [(0, len(body))]:
        return [(0, len(run), *battery(run))]
    joined = "".join(PART.findall(body))
    whole = [battery(run), *([battery(joined)] if len(joined) >= LEAST_RUN else [])]
    long_parts = [(s, e, *battery(body[s:e])) for s, e in parts if e - s >= LEAST_RUN]
    n = len(whole) + len(long_parts)
    name, p = min(whole, key=lambda x: x[1])
    if any(x[3] < p for x in long_parts):
        return [(s, e, x, min(1.0, q * n)) for s, e, x, q in long_parts]
    return [(0, len(run), name, min(1.0, p * n))]


def candidates(text: str, data: bytes, base: list[tuple[int, int, int]]) -> list[dict]:
    """Runs, or their parts, that lie inside no base span, with their band and rounded p-value."""
    if b"x" * LEAST_RUN not in data.translate(RUN_BYTES):
        return []
    out = []
    starts = [s for s, _, _ in base]  # in order; the farthest end so far tells whether any span holds a run
    farthest = list(accumulate((e for _, _, e in base), max))

    def held(start: int, end: int) -> bool:
        before = bisect_right(starts, start)
        return before > 0 and farthest[before - 1] >= end

    for m in RUN.finditer(text):
        for first, last, name, p in () if held(*m.span()) else tested(m[0]):
            start, end = m.start() + first, m.start() + last
            if held(start, end):
                continue
            out.append({"start": start, "end": end, "encoding": name, "band": band(end - start), "bin": min(MOST_BIN, int(-10 * math.log10(max(p, 1e-60))))})
    return out


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
CANDIDATE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("band", pa.int32()), ("bin", pa.int32())]))


def scan_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document with its base spans and its tested candidates."""
    body, base, runs_ = fresh(keep, "body", "base", "tested")
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(body))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, runs = [], []
            for value in batch.column(len(keep)):
                t = value.as_py()
                data = t.encode()
                found = base_spans(t, data)
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                runs.append(candidates(t, data, found))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(bases, SPAN), pa.array(runs, CANDIDATE)], names=[*keep, base, runs_])

    schema = ", ".join([
        *(f"`{c}` {kind(docs, c)}" for c in keep), f"`{base}` array<struct<start:bigint,kind:int,end:bigint>>",
        f"`{runs_}` array<struct<start:bigint,end:bigint,encoding:string,band:int,bin:int>>",
    ])
    return rows.mapInArrow(scan, schema)


def thresholds(runs: DataFrame, level: float) -> list[int]:
    """For each length band the least rounded p-value that counts as a find.

    `runs` has `band` and `bin` of every candidate. What reaches the driver is one count for each
    band and bin: at most four times 401 rows, whatever the corpus.
    """
    counts = np.zeros((len(BANDS) + 1, MOST_BIN + 1), dtype=np.int64)
    for b, k, n in runs.groupBy("band", "bin").count().collect():
        counts[b, k] = n
    least = []
    for row in counts:
        above, total = row[::-1].cumsum()[::-1], row.sum()
        good = [k for k in range(1, MOST_BIN + 1) if above[k] and 10 ** (-k / 10) <= level * above[k] / total]
        least.append(min(good, default=MOST_BIN + 1))
    return least


def secret_scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), level: float = 0.01) -> DataFrame:
    """The kept columns and `spans`, an array of (start, kind, end) by start, then kind.

    `level` bounds the expected share of false finds among the random kind. A null or empty text
    has no spans; repeated rows are scanned one by one, and each counts as a test of its own.
    """
    (spans,) = fresh(keep, "spans")
    base, runs = fresh(keep, "base", "tested")
    scanned = checkpointed(scan_spans(docs, text, keep))
    least = thresholds(scanned.select(F.explode(runs).alias("c")).select("c.band", "c.bin"), level)
    bound = F.array(*[F.lit(x) for x in least])
    found = F.filter(runs, lambda c: c["bin"] >= F.element_at(bound, c["band"] + 1))
    extra = F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.select(*keep, F.array_sort(F.concat(F.col(base), extra)).alias(spans))


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == k  # a second parameter would get the element's place


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    found = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def listed(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts[:3], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), counts[3])
