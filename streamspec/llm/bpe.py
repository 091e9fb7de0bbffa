"""Byte-level BPE encoding and decoding over distinct words.

Texts are cut into pre-tokens. A task numbers the distinct words of a chunk of texts by falling
frequency and writes, once, two kinds of rows to the shared folder: for each bucket of words (by a
hash of the word) the words of the chunk that fall in it, and for the chunk the positions, as word
numbers. The global shuffle moves the words by bucket, never the occurrences: each distinct
word of the corpus meets all its chunks in one task and is encoded there once. Its ids go back by
chunk, where texts are put together by position; positions are written in hash buckets of chunks,
so that they need not move. Decoding looks tokens up in the token-byte table.

A word is at most once in a chunk's rows, so no word, however frequent, makes a hot partition.

Defined results: null and empty texts have no tokens; a text longer than a chunk is a chunk of its
own; repeated rows give equal rows; an empty table gives an empty one; further columns are ignored;
null identifiers stay null; text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from streamspec.llm import vocabulary
from streamspec.llm.common import bucketed, texts_of

#: Characters of text in a chunk, which bounds the words that a task holds.
CHUNK = 14_000_000


class _Numbers(dict):
    """Numbers in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _planes(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, as many planes as they need, compressed."""
    raw = np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4)
    top = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([top]) + zstandard.compress(np.ascontiguousarray(raw[:, :top].T).tobytes(), 3)


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u4").ravel()


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings as their lengths and all bytes, compressed."""
    lengths = _planes(np.fromiter(map(len, parts), np.uint32, len(parts)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(parts), 3)


def _unpack(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(_unplanes(data[4 : 4 + n]), dtype=np.int64).tolist()
    raw = zstandard.decompress(data[4 + n :])
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunked(docs: DataFrame, pattern: str, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of all chunks: words by bucket (bucket >= 0); positions of the texts, with the numbers
    of the words in the order of buckets (bucket = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part = vocabulary.splitter(pattern), TaskContext.get().partitionId() << 32
        kind = schema.field("docs").type.value_type
        numbers, texts, size, ids = _Numbers(), [], 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal part, size
            words = list(numbers)
            n = np.bincount(np.concatenate(texts), minlength=len(words)) if texts else np.zeros(0, int)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            raw = [w.encode() for w in words]
            home = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            by_home = np.array(sorted(range(len(raw)), key=lambda i: (home[i], raw[i])), np.int64)  # neighbours share beginnings
            cuts = np.flatnonzero(np.diff(home[by_home], prepend=-1))
            for own in np.split(by_home, cuts[1:]) if len(raw) else []:
                words = _pack([raw[i] for i in own])
                yield pa.RecordBatch.from_pylist([{"chunk": part, "bucket": int(home[own[0]]), "words": words}], schema)
            counts = np.fromiter(map(len, texts), np.uint32, len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part]), pa.array([-1], pa.int32()), pa.array([pa.array(ids, kind).to_pylist()], pa.list_(kind)),
                    *(pa.array([x], pa.binary()) for x in (_planes(counts), _planes(rank[np.concatenate(texts)]), _planes(rank[by_home]), None)),
                ],
                schema=schema,
            )
            part += 1
            numbers.clear()
            texts.clear()
            ids.clear()
            size = 0

        for batch in batches:
            own = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 256):
                for i, text in enumerate(texts_of(batch.column(1).slice(at, 256)), at):
                    tokens = split(text)
                    texts.append(np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens)))
                    ids.append(own[i])
                    size += len(text)
                    if size >= CHUNK:
                        yield from flush()
        if ids:
            yield from flush()

    src = docs.select(F.col(id_col), F.col(text_col))
    id_type = src.schema[id_col].dataType
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("docs", pa.list_(to_arrow_type(id_type))), ("counts", pa.binary()), ("numbers", pa.binary()), ("home", pa.binary()), ("words", pa.binary())])
    return src.mapInArrow(run, f"chunk long, bucket int, docs array<{id_type.simpleString()}>, counts binary, numbers binary, home binary, words binary")


def encoded_words(rows: DataFrame, ranks: str, pattern: str, partitions: int) -> DataFrame:
    """chunk, bucket, and lengths and ids of the words, each distinct word encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bucket, known = vocabulary.encoding(ranks, pattern), None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    bucket, known = r["bucket"], {}
                ids = []
                for w in _unpack(r["words"]):
                    own = known.get(w)
                    if own is None:
                        own = known[w] = enc._core_bpe.encode_single_piece(w)
                    ids.append(own)
                yield pa.RecordBatch.from_pydict({
                    "chunk": [r["chunk"]],
                    "bucket": pa.array([r["bucket"]], pa.int32()),
                    "lengths": [_planes(np.fromiter(map(len, ids), np.uint32, len(ids)))],
                    "ids": [_planes(np.fromiter((i for own in ids for i in own), np.uint32))],
                })

    words = rows.where("bucket >= 0").select("bucket", "chunk", "words")
    return words.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, bucket int, lengths binary, ids binary")


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, buckets: int | None = None) -> DataFrame:
    """The identifier and ids of every text; with digests instead n_tokens and the SHA-256 of the ids
    and of the bytes that they decode to."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed(chunked(docs, pattern, buckets or max(64, partitions), id_col, text_col), partitions, "chunk", "chunks")
    words = F.collect_list(F.struct("bucket", "lengths", "ids")).alias("known")  # at most a chunk's words
    known = encoded_words(rows, ranks, pattern, partitions).groupBy("chunk").agg(words)
    chunks = rows.where("bucket < 0").select("chunk", "docs", "counts", "numbers", "home").join(known, "chunk", "left")
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks, pattern)
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1)
                words = _words(r.column("known")[0].as_py() or [], _unplanes(r.column("home")[0].as_py()))
                size = np.fromiter(map(len, words), np.int64, len(words))
                if digests:
                    text = np.array([" ".join(map(str, w)) for w in words], object)
                    raw = np.array([b"".join([table[i] for i in w]) for w in words], object)
                ids = r.column("docs").flatten()
                counts, numbers = _unplanes(r.column("counts")[0].as_py()), _unplanes(r.column("numbers")[0].as_py())
                places = np.split(numbers, np.cumsum(counts, dtype=np.int64)[:-1])
                for a in range(0, len(places), 256):
                    own = places[a : a + 256]
                    if digests:
                        out = {
                            "n_tokens": [int(size[p].sum()) for p in own],
                            "ids_sha256": [hashlib.sha256(" ".join(text[p].tolist()).encode()).hexdigest() for p in own],
                            "decoded_sha256": [hashlib.sha256(b"".join(raw[p].tolist())).hexdigest() for p in own],
                        }
                    else:
                        out = {"ids": pa.array([[t for i in p.tolist() for t in words[i]] for p in own], pa.list_(pa.int32()))}
                    yield pa.RecordBatch.from_pydict({id_col: ids.slice(a, 256), **out})

    result = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return chunks.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, {result}")


def _words(known: list[dict], numbers: np.ndarray) -> list[list[int]]:
    """The ids of a chunk's words by their numbers, which are in the order of buckets."""
    out: list[list[int]] = [[]] * len(numbers)
    number = iter(numbers.tolist())
    for k in sorted(known, key=lambda k: k["bucket"]):
        flat, at = _unplanes(k["ids"]).tolist(), 0
        for n in _unplanes(k["lengths"]).tolist():
            out[next(number)] = flat[at : at + n]
            at += n
    return out


def token_bytes(ranks: str, pattern: str) -> dict[int, bytes]:
    """The token-byte table."""
    return {rank: token for token, rank in vocabulary.encoding(ranks, pattern)._mergeable_ranks.items()}


def decode(tokens: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The identifier and the bytes of each list of ids; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks, pattern)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "bytes": pa.array([None if r is None else b"".join([table[i] for i in r]) for r in rows], pa.binary())})

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")
