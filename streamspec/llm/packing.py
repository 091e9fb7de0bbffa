"""Packing tokenised documents into sequences of a fixed length by best-two-fit.

Only the number of documents of each length matters to how they are packed, and there are at most
as many lengths as a sequence has places. So the documents are counted by length where they are,
the driver packs the counts (a table of at most ``capacity`` rows, whatever the corpus) into
patterns, each a bin and how often it is used, and every document finds its own place from its
rank among the documents of its length.

Ids are those of the ``tokenizers`` library with the vocabulary's settings as they are: a string that
the file lists as an added token is that token, unless special_as_text. The library is asked for
distinct pre-tokens, or for whole texts where they hold an added token.

Best-two-fit: a bin is filled greedily, largest document first; then its smallest document is
replaced by two unpacked ones that fit the gap, widened by it, more tightly, as long as there are.

Defined results: null and empty texts are the end token alone; texts of more than ``capacity``
tokens are cut into full pieces, the first one taking what is over; repeated rows are packed as
documents of their own; ties among equal lengths go by the order of the tokenised table; an empty
table gives no sequence; further columns are ignored; null identifiers stay null.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamspec.llm import vocabulary
from streamspec.llm.common import materialise, texts_of

CAPACITY = 1024
END_ID = 2


def _pieces(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of n tokens."""
    first = (n - 1) % capacity + 1
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def tokenised(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """A row for each piece: identifier, piece, start, length, ids_crc32, and part and rank, its place
    among the pieces of its length in its task; with_ids adds the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = vocabulary.text_ids(vocabulary_path, special_as_text), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                source, cols = [], {k: [] for k in ("piece", "start", "length", "ids_crc32", "rank", *(["ids"] * with_ids))}
                for i, text in enumerate(texts_of(rows.column(1))):
                    ids = np.frombuffer(ids_of(text) + end, "<u4")
                    for k, (start, length) in enumerate(_pieces(len(ids), capacity)):
                        source.append(i)
                        own = ids[start : start + length]
                        values = [k, start, length, zlib.crc32(own.tobytes()), seen[length], *([own.astype(np.int32)] * with_ids)]
                        for name, value in zip(cols, values, strict=True):
                            cols[name].append(value)
                        seen[length] += 1
                cols["piece"] = pa.array(cols["piece"], pa.int32())
                yield pa.RecordBatch.from_pydict({id_col: rows.column(0).take(pa.array(source, pa.int64())), **cols, "part": pa.array([part] * len(source), pa.int32())})

    src = docs.select(F.col(id_col), F.col(text_col))
    kind = src.schema[id_col].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    return src.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, rank long{more}, part int")


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns that pack counts[n] documents of each length n: how often, and the lengths in a bin.

    Each pattern is repeated until one of its lengths runs out, so there are few: their number
    follows the number of lengths, not of documents.
    """
    left = np.array(counts, np.int64)
    sizes = np.arange(capacity + 1)
    out: list[tuple[int, list[int]]] = []

    def largest(free: np.ndarray) -> np.ndarray:
        """The largest length with free documents up to each length, 0 for none."""
        return np.maximum.accumulate(np.where(free > 0, sizes, 0))

    while left.any():
        bin_, gap, free = [], capacity, left.copy()
        while gap:
            n = int(largest(free)[gap])
            if not n:
                break
            k = min(int(free[n]), gap // n)
            bin_ += [n] * k
            free[n] -= k
            gap -= n * k
        while gap and len(bin_) > 1:
            smallest, room = bin_[-1], gap + bin_[-1]
            first = sizes[1 : room][free[1:room] > 0]
            once = free.copy()
            once[free == 1] = 0  # a length with one free document gives no pair with itself
            below, twice = largest(free), once[first] > 0
            second = below[np.minimum(first - 1, room - first)]
            second = np.where(twice & (first <= room - first), first, second)
            total = np.where(second > 0, first + second, 0)
            if not len(total) or total.max() <= smallest:
                break
            i = int(np.flatnonzero(total == total.max())[-1])
            a, b = int(first[i]), int(second[i])
            bin_.pop()
            free[smallest] += 1
            free[a] -= 1
            free[b] -= 1
            bin_ = sorted([*bin_, a, b], reverse=True)
            gap = room - a - b
        used = Counter(bin_)
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
        out.append((times, bin_))
    return out


def _slots(patterns: list[tuple[int, list[int]]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows by rank: first rank, first sequence, first offset, documents in a bin."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for times, bin_ in patterns:
        offset = 0
        for n, k in sorted(Counter(bin_).items(), reverse=True):
            slots.setdefault(n, []).append((ranks[n], sequence, offset, k))
            ranks[n] += times * k
            offset += n * k
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces has length, part and rank and is read twice, so it
    should be a written table."""
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    starts = by_part.select("length", "part", before.alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most capacity rows
        counts[r.length] = r.n
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(best_two_fit(counts, capacity), capacity))  # bounded by capacity alone
    names = [n for n in pieces.columns if n not in ("part", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = table[int(n)]
                slot = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                own = rank[at] - slot[:, 0]
                sequence[at] = slot[:, 1] + own // slot[:, 3]
                offset[at] = slot[:, 2] + own % slot[:, 3] * n
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"sequence_id": sequence, "offset": offset})

    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return pieces.join(starts, ["length", "part"]).select(*names, "rank", "before").mapInArrow(place, schema)


def packed(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """Pieces of docs and their places in sequences."""
    return pack(materialise(tokenised(docs, vocabulary_path, capacity, end_id, with_ids=with_ids, special_as_text=special_as_text), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from pieces with their ids; a sequence has a bounded length."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))
