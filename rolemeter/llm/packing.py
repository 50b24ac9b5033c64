"""Cost-balanced packing of token sequences.

Documents are encoded and dealt to sequences in windows of about a million tokens, inside the task
that read them: nothing is shuffled, and a task holds one window. Within a window, whole sequences'
worth of long documents is cut off first. The other pieces go, costliest first, each to the
sequence of least cost that still has room for it; a piece that fits nowhere fills the largest room
and the rest of it goes on. The cost of a piece of n tokens is n + n * n / length: the linear part
of a layer and the attention inside the piece.

The sequences of a window are exactly as long as its tokens: what is over a multiple of the length
is carried into the next window, and in the last one split into sequences of powers of two, which
need no padding. So no sequence is padded at all.
"""

from __future__ import annotations

import functools
import heapq
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemeter.llm.shared import fresh, kind, slices, table

LENGTH = 4096
END = 2
WINDOW = 1 << 20
#: Lowered words of a generation whose ids a task remembers, two generations of them.
REMEMBERED = 200_000
#: The same of other words, which differ more and come again less.
OTHERS = 20_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words that need none of the vocabulary's normalising but lowering: precomposed letters, then marks.
SIMPLE = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?%*$&#-]*)$"
#: Texts are encoded together by so many bytes.
TOGETHER = 1 << 22


class Remembered:
    """A dictionary of two generations: what was not asked for during a whole one is forgotten."""

    def __init__(self, most: int = REMEMBERED) -> None:
        self.most, self.young, self.old = most, {}, {}

    def absent(self, keys: list) -> list:
        """Make the keys' values ready in `young` and give the keys that have none yet."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        missing, young = [], self.young
        for k in keys:
            if k not in young:
                value = self.old.get(k)
                if value is None:
                    missing.append(k)
                else:
                    young[k] = value
        return missing


class Ragged:
    """Arrays of ids, one after another."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.lengths = ids, lengths

    @classmethod
    def of(cls, values: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(values), dtype="<u4"), np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4)

    def take(self, places: np.ndarray) -> Ragged:
        """The arrays at these places."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        starts = (np.cumsum(self.lengths) - self.lengths)[places]
        return Ragged(self.ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths)

    def and_then(self, other: Ragged) -> Ragged:
        """Each array followed by the other's of the same place."""
        n = len(self.lengths)
        both = Ragged(np.concatenate([self.ids, other.ids]), np.concatenate([self.lengths, other.lengths]))
        joined = both.take(np.stack([np.arange(n), np.arange(n) + n], axis=1).ravel())
        return Ragged(joined.ids, self.lengths + other.lengths)


class Encoder:
    """Token ids of texts.

    The vocabulary drops white space and no token crosses it, so a text's ids are those of its
    blank-separated words in order. The distinct words of some megabytes of text are encoded
    together; of simple words, which differ only in case or the mark that follows them, the lowered letters are,
    and their ids are remembered, as are those of the other words.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for lowered letters, what is left to do is the merging
        self.merging = Tokenizer(self.tokenizer.model)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merging.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.letters, self.words = Remembered(), Remembered(OTHERS)

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: encoded as texts of many words, and parted where a token ends a word."""
        out = []
        for found in self.merging.encode_batch_fast([" ".join(words[at : at + 2000]) for at in range(0, len(words), 2000)], add_special_tokens=False):
            ids = np.array(found.ids, dtype="<u4")
            data, start = ids.tobytes(), 0
            for end in (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist():
                out.append(data[start:end])
                start = end
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remembered(self, memory: Remembered, words: list[str], encode: Callable[[list[str]], list[bytes]]) -> Ragged:
        missing = memory.absent(words)
        memory.young.update(zip(missing, encode(missing), strict=True))
        return Ragged.of(list(map(memory.young.__getitem__, words)))

    def _words(self, words: pa.Array) -> Ragged:
        """Ids of different words."""
        parts = pc.extract_regex(words, SIMPLE)
        simple = parts.is_valid().to_numpy(zero_copy_only=False)
        parts = parts.drop_null()
        letters = pc.utf8_lower(parts.field("letters")).dictionary_encode()
        marks = parts.field("marks").dictionary_encode()
        first = self._remembered(self.letters, letters.dictionary.to_pylist(), self._merged).take(letters.indices.to_numpy())
        rest = Ragged.of(self._plain(marks.dictionary.to_pylist())).take(marks.indices.to_numpy())
        others = self._remembered(self.words, words.filter(pa.array(~simple)).to_pylist(), self._plain)
        joined = first.and_then(rest)
        both = Ragged(np.concatenate([joined.ids, others.ids]), np.concatenate([joined.lengths, others.lengths]))
        return both.take(np.argsort(np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)]), kind="stable"))

    def encoded(self, texts: pa.Array) -> Ragged:
        """Ids of texts that are encoded together."""
        pieces = pc.ascii_split_whitespace(texts)
        words = pieces.flatten()
        filled = pc.not_equal(pc.binary_length(words), 0)  # space at an end of a text gives an empty piece
        numbered = words.filter(filled).dictionary_encode()
        found = self._words(numbered.dictionary).take(numbered.indices.to_numpy())
        row = np.repeat(np.arange(len(texts)), np.diff(pieces.offsets.to_numpy()))[filled.to_numpy(zero_copy_only=False)]
        return Ragged(found.ids, np.bincount(row, weights=found.lengths, minlength=len(texts)).astype(np.int64))

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """Token ids of each text, as little-endian 32-bit bytes."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        for begin, size in slices(texts, TOGETHER):
            found = self.encoded(texts.slice(begin, size))
            start = 0
            for n in found.lengths.tolist():
                yield found.ids[start : start + n].tobytes()
                start += n


@functools.cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker: what a task has learned serves the next."""
    return Encoder(path)


def cost(n: int, length: int) -> float:
    return n + n * n / length


def capacities(total: int, length: int) -> list[int]:
    """Full sequences, and powers of two for the rest."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def assign(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences are filled exactly."""
    rooms = np.array(capacities(sum(lengths), length), dtype=np.int64)
    out, pieces, used = [], [], 0
    for i, n in enumerate(lengths):
        whole = n // length
        for k in range(whole):
            out.append((i, k * length, length, used + k, 0))
        used += whole
        if n % length:
            pieces.append((-(n % length), i, whole * length))
    rooms[:used] = 0
    filled, costs = np.zeros(len(rooms), dtype=np.int64), np.zeros(len(rooms))
    heapq.heapify(pieces)
    while pieces:
        n, i, start = heapq.heappop(pieces)
        n = -n
        fits = rooms >= n
        at = int(np.where(fits, costs, np.inf).argmin())
        if not fits[at]:
            at = int(rooms.argmax())
            heapq.heappush(pieces, (int(rooms[at]) - n, i, start + int(rooms[at])))
            n = int(rooms[at])
        out.append((i, start, n, at, int(filled[at])))
        rooms[at] -= n
        filled[at] += n
        costs[at] += cost(n, length)
    return out


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, end: int = END, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row a piece: the key, `start`, `length`, `ids`, `doc_tokens`, `sequence_id`, `offset`.

    `ids` are little-endian unsigned 32-bit integers. A null or empty text is the end token alone.
    Repeated rows are packed one by one. Sequences are numbered by the scan's task and then upward;
    a task that runs again reads the same rows and gives the same pieces. An empty table gives none.
    """
    path = path or vocabulary()
    names = [key, *fresh([key], "start", "length", "ids", "doc_tokens", "sequence_id", "offset")]
    key_type = docs.schema[key].dataType
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(fresh([key], "body")[0]))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """Documents as [key, ids, tokens, first token that is left, and the end of what is left if cut]."""
        held, total = [], 0
        finish = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1)), strict=True):
                ids += finish
                held.append([k, ids, len(ids) // 4, 0])
                total += len(ids) // 4
                if total >= max(window, length):
                    over, carried = total % length, []
                    while over:  # the tail of the last documents goes to the next window
                        last = held[-1]
                        take = min(over, last[2] - last[3])
                        carried.insert(0, [last[0], last[1], last[2], last[2] - take])
                        over -= take
                        if last[2] - last[3] == take:
                            held.pop()
                        else:
                            held[-1] = [*last, last[2] - take]
                    yield held
                    held, total = carried, sum(x[2] - x[3] for x in carried)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for held in windows(batches):
            stops = [x[4] if len(x) > 4 else x[2] for x in held]
            found = assign([stop - x[3] for x, stop in zip(held, stops, strict=True)], length)
            columns: list[list] = [[] for _ in names]
            for i, start, n, sequence, offset in found:
                k, ids, tokens, first = held[i][:4]
                start += first
                for column, value in zip(columns, (k, start, n, ids[4 * start : 4 * (start + n)], tokens, number + sequence, offset), strict=True):
                    column.append(value)
            number += 1 + max(x[3] for x in found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(key_type), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, [kind(docs, key), "bigint", "bigint", "binary", "bigint", "bigint", "bigint"], strict=True))
    return rows.mapInArrow(run, schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
