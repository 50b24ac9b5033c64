"""Token counts by section: whole documents are encoded once and tokens are dealt to character spans.

A byte-level vocabulary loses nothing, so the lengths of a document's tokens add up to its UTF-8
length: their running sum gives every token's span. Sections come as spans of code points; sorted
searches in the running sum join both sets of intervals. A token that crosses a boundary goes by
an explicit rule:

* `first`: to the section that holds its first byte;
* `most`: to the section that holds most of its bytes, of equals the first;
* `share`: to each section by its share of the bytes, a fraction.

Tokens outside all sections are counted for the section null.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemeter.llm.shared import fresh, kind, table

RULES = ("first", "most", "share")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """A byte-level vocabulary and the byte length of each of its tokens; built once per task."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def byte_places(text: str, data: bytes, points: np.ndarray) -> np.ndarray:
    """Byte offsets of code point offsets."""
    if len(text) == len(data):
        return points
    codes = np.frombuffer(data, dtype=np.uint8)
    starts = np.append(np.flatnonzero((codes & 0xC0) != 0x80), len(codes))
    return starts[points]


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text; a break belongs to the line it ends, and an empty text has no line."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype="<u4") == 10) + 1
    if text and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    return np.concatenate([np.zeros(min(1, len(ends)), dtype=np.int64), ends[:-1]]), ends


def deal(lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its tokens cross its boundary.

    `lengths` are the bytes of each token; sections are sorted, disjoint byte spans.
    """
    edges = np.concatenate([[0], np.cumsum(lengths)])
    first = np.searchsorted(edges, starts, "right") - 1  # the token that holds the first byte
    last = np.searchsorted(edges, ends, "left")  # one after the token that holds the last byte
    full = ends > starts
    first, last = np.where(full, first, 0), np.where(full, last, 0)
    cut_left = full & (edges[first] < starts)
    cut_right = full & (edges[last] > ends)
    touched = (last - first).astype(np.float64)
    crossing = cut_left.astype(np.int64) + cut_right - (cut_left & cut_right & (last - first == 1))
    if rule == "first":
        touched -= cut_left
    elif rule == "share":
        size = np.maximum(lengths, 1)
        inside = np.where(full, np.minimum(edges[np.minimum(first + 1, len(edges) - 1)], ends) - starts, 0)
        touched -= np.where(cut_left, 1 - inside / size[np.minimum(first, len(size) - 1)], 0)
        inside = ends - edges[np.maximum(last - 1, 0)]
        one = cut_left & (last - first == 1)
        touched -= np.where(cut_right & ~one, 1 - inside / size[np.maximum(last - 1, 0)], 0)
    else:
        shared: dict[int, list[int]] = {}
        for i in np.flatnonzero(cut_left):
            shared.setdefault(int(first[i]), []).append(int(i))
        for i in np.flatnonzero(cut_right):
            sections = shared.setdefault(int(last[i]) - 1, [])
            if int(i) not in sections:
                sections.append(int(i))
        for token, sections in shared.items():
            held = [(min(edges[token + 1], ends[i]) - max(edges[token], starts[i]), -i) for i in sections]
            outside = lengths[token] - sum(h for h, _ in held)
            best = max(held)
            touched[sections] -= 1
            if best[0] >= outside:
                touched[-best[1]] += 1
    return touched, crossing


def section_tokens(
    docs: DataFrame, sections: Column | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rule: str = "most", path: str | None = None,
) -> DataFrame:
    """One row per section: kept columns, `section`, `start`, `end`, `n_tokens` and `n_crossing`.

    `sections` is an array of structs (start, end) of code points, end exclusive, sorted and
    disjoint; spans are cut to the text. Without it the sections are the lines. A further row with the section -1 counts the tokens that
    fall to none, where there are any. A null or empty text has no tokens: its sections count 0,
    and a null array gives no rows of sections. Each of repeated rows is counted for itself.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or vocabulary()
    body, spans = fresh(keep, "body", "spans")
    lines = sections is None
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(body), *([] if lines else [F.coalesce(sections, F.array()).alias(spans)]))
    width = len(keep)
    share = rule == "share"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            take, number, start, end, tokens, crossing = [], [], [], [], [], []
            if not lines:
                flat = batch.column(width + 1)
                offsets = flat.offsets.to_numpy()
                all_starts, all_ends = (flat.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, value in enumerate(batch.column(width)):
                t = value.as_py()
                data = t.encode()
                lengths = own.lengths[np.asarray(own.encode(t), dtype=np.int64)]
                if lines:
                    s, e = line_spans(t)
                else:
                    s = np.clip(all_starts[offsets[i] : offsets[i + 1]], 0, len(t)).astype(np.int64)
                    e = np.clip(all_ends[offsets[i] : offsets[i + 1]], s, len(t)).astype(np.int64)
                n, c = deal(lengths, byte_places(t, data, s), byte_places(t, data, e), rule) if len(s) else (np.zeros(0), np.zeros(0, dtype=np.int64))
                rest = len(lengths) - float(n.sum())
                ids = np.arange(len(s))
                if rest > 1e-9:
                    ids, s, e, n, c = np.append(ids, -1), np.append(s, -1), np.append(e, -1), np.append(n, rest), np.append(c, 0)
                for store, values_ in ((take, np.full(len(ids), i)), (number, ids), (start, s), (end, e), (tokens, n), (crossing, c)):
                    store.append(values_)
            if not take:
                continue
            chosen = pa.array(np.concatenate(take))
            counted = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(chosen) for k in range(width)),
                    *(pa.array(np.concatenate(x), pa.int64()) for x in (number, start, end)),
                    pa.array(counted, pa.float64()) if share else pa.array(np.rint(counted).astype(np.int64)),
                    pa.array(np.concatenate(crossing).astype(np.int64)),
                ],
                names=names,
            )

    names = [*keep, *fresh(keep, "section", "start", "end", "n_tokens", "n_crossing")]
    kinds = [*(kind(docs, c) for c in keep), "bigint", "bigint", "bigint", "double" if share else "bigint", "bigint"]
    return rows.mapInArrow(count, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def op2_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return section_tokens(table(spark, sf_dir, "documents"))
