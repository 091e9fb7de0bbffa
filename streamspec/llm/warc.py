"""WARC archives: written through Spark's own committer, read back by boundary chains.

Writing. A response record for the first row of each payload, revisit records for the others. A
record is a header, an HTTP response and an empty line, so the text writer with that empty line as
separator writes archives: tasks that are retried or lost leave nothing behind.

Reading. Archives are cut into byte ranges, however small they are. A task looks for the magic in its range and emits, for
each candidate, where the record would end; within the range it already follows such successors to
the first offset outside. Pointer jumping from the start of each file, doubling the distance in
each round, then finds the one true entry of every range. Whatever was not reached, such as magic
inside payloads, is no record. A last pass walks each range from its entry and checks digests.

Defined results: null payloads are empty; identifiers of any atomic type come back with their type, a
null one as null; of equal payloads (by SHA-256 and length; the SHA-1 of the header decides nothing)
the row with the smallest identifier (null last; then by file and row) is the response, so repeated
rows leave one response; very long payloads stay in one record; an empty table writes no record and
reads none; further columns are ignored; line breaks in addresses are percent-encoded; headers are
read whole, however long; a chain that ends before its file does, by a record that the end of the
file cuts off or by anything that is no record where one should be, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType

from streamspec.llm.common import discard, materialise, scratch
from streamspec.llm.exact_dedup import located, sha256

MAGIC = b"WARC/1."
END = b"\r\n\r\n"
#: Bytes of a range, ranges in a row that a task reads through one open file, and the first step in
#: which a header that goes on after its range is read.
RANGE = 256 << 10
RUN = 64
STEP = 1 << 16
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare base32 SHA-1: 40 bits at a time to 8 digits."""
    h = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, _HEX32, _BASE32)


def id_text(ident: Column, kind: DataType) -> Column:
    """An identifier as text without colons, and without anything that ends a header."""
    return F.hex(ident) if isinstance(kind, BinaryType) else F.url_encode(ident.cast("string"))


def id_value(text: Column, kind: DataType) -> Column:
    """The identifier of a text that id_text gave."""
    return F.unhex(text) if isinstance(kind, BinaryType) else F.url_decode(text).cast(kind)


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int, date: str) -> DataFrame:
    """One column, the record of each row as text, without the empty line that ends it."""
    pages, at = located(pages)
    kind = pages.schema[id_col].dataType
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"),
        base32_sha1(payload.cast("binary")).alias("digest"), sha256(payload).alias("content"), F.octet_length(payload).alias("bytes"), F.col(at).alias("at"),
    )
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("first")
    groups = rows.where(F.col("bytes") >= min_bytes).groupBy("content", "bytes").agg(first, F.count(F.lit(1)).alias("n"))
    # Only payloads that repeat are joined back. They are written first, so that Spark knows their
    # size: few are broadcast and the payloads stay where they are, many are joined by a shuffle.
    repeated = materialise(groups.where("n > 1").select("content", "bytes", "first"), "repeated")
    rows = rows.join(repeated, ["content", "bytes"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first.at") != F.col("at"))

    def urn(ident: Column, at: Column) -> Column:
        named = F.concat(F.lit("page:"), id_text(ident, kind), F.lit(":"))
        return F.concat(F.lit("<urn:streamspec:"), F.coalesce(named, F.lit("nameless:")), F.hex(F.xxhash64(at)), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            F.lit("\r\nWARC-Record-ID: "), urn(F.col("id"), F.col("at")),
            F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
            F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
            F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("first.id"), F.col("first.at")))).otherwise(F.lit("")),
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block_bytes.cast("string"), F.lit("\r\n\r\n"),
            http, F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        ).alias("value")
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of pages in the folder path. Payloads under min_bytes bytes are never revisits."""
    records(pages, id_col, url_col, payload_col, min_bytes, date).write.option("lineSep", END.decode()).text(path)


def _open(path: str) -> pa.NativeFile:
    """A file by the address that Spark gives."""
    uri = re.sub(r"^file:/+", "file:///", path)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    system, name = pa.fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def _at(f: pa.NativeFile, start: int, n: int) -> bytes:
    f.seek(start)
    return f.read(n)


def _header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The fields of the record header at a place, lower-case names, and where its block begins."""
    end = data.find(END, at)
    if end < 0:
        return None
    first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not re.fullmatch(r"WARC/1\.[0-9]+", first) or not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        return None
    return fields, end + len(END)


def _head(f: pa.NativeFile, offset: int) -> bytes | None:
    """The bytes from an offset of a file past the empty line of a header, read in growing steps
    however long it is; None where the file ends in the header, short where no header begins."""
    data, step = b"", STEP
    while more := _at(f, offset + len(data), step):
        searched = max(0, len(data) - len(END) + 1)
        data += more
        if data.find(END, searched) >= 0 or not data.startswith(MAGIC[: len(data)]):
            return data
        step = len(data)
    return None


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> tuple[DataFrame, int, int]:
    """path, length, k, start and stop of all byte ranges, the number of runs, and the most ranges of a
    file. No content is read here. Runs of ranges stay together, so that a task opens a file once for each."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    n, most = files.select(F.sum(F.ceil(F.col("length") / (size * RUN))), F.max(F.ceil(F.col("length") / size))).first()
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / size) - 1)).alias("k"))
    cut = cut.select("path", "length", "k", (F.col("k") * size).alias("start"), F.least("length", (F.col("k") + 1) * size).alias("stop"))
    return cut, int(n or 0), int(most or 0)


def in_runs(cut: DataFrame, runs: int) -> DataFrame:
    """Ranges, each run of a file in one task and in order."""
    parts = max(1, min(runs, 20_000))
    return cut.repartition(parts, "path", F.floor(F.col("k") / RUN)).sortWithinPartitions("path", "k")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.NativeFile]]:
    """The rows of batches, each with its open file."""
    path, f = None, None
    try:
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != path:
                    if f:
                        f.close()
                    path, f = r["path"], _open(r["path"])
                yield r, f
    finally:
        if f:
            f.close()


def candidates(cut: DataFrame) -> DataFrame:
    """path, k, offset, successor and exit of every candidate record: exit is the first offset outside
    the range that following successors gets to, null where a successor is no candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, f in _files(batches):
            start, stop, before = r["start"], r["stop"], min(r["start"], len(END))
            data = _at(f, start - before, before + stop - start + len(MAGIC))
            found: list[tuple[int, int]] = []
            at = data.find(MAGIC)
            while at >= 0:
                offset = start - before + at
                if start <= offset < stop and (offset == 0 or data[at - len(END) : at] == END):
                    if data.find(END, at) < 0:
                        head = _header(_head(f, offset) or b"", 0)
                        body = offset + head[1] if head else 0
                    else:
                        head = _header(data, at)
                        body = start - before + head[1] if head else 0
                    if head:
                        found.append((offset, body + int(head[0]["content-length"]) + len(END)))
                at = data.find(MAGIC, at + 1)
            exits: dict[int, int | None] = {}
            for offset, successor in reversed(found):  # successors are always further on
                exits[offset] = successor if successor >= stop else exits.get(successor)
            yield pa.RecordBatch.from_pylist(
                [{"path": r["path"], "k": r["k"], "offset": o, "successor": s, "exit": exits[o]} for o, s in found],
                pa.schema([("path", pa.string()), ("k", pa.int64()), ("offset", pa.int64()), ("successor", pa.int64()), ("exit", pa.int64())]),
            )

    return cut.mapInArrow(run, "path string, k long, offset long, successor long, exit long")


def entries(found: DataFrame, most: int) -> DataFrame:
    """path and offset of the first true record in each range, by pointer jumping from offset 0.

    Only candidates that some exit points to can be entries. Rounds: the logarithm of the most
    ranges that a file has; a file of one range needs none.
    """
    reached = found.where("offset = 0").select("path", "offset")
    targets = found.where("exit IS NOT NULL").select("path", F.col("exit").alias("offset")).distinct()
    starts = found.where("offset = 0").unionByName(found.where("offset > 0").join(targets, ["path", "offset"], "left_semi").select(*found.columns))
    jumps = materialise(starts.select("path", "offset", "exit"), "jumps")
    rounds = max(0, most - 1).bit_length()
    for i in range(rounds):
        further = reached.join(jumps, ["path", "offset"]).select("path", F.col("exit").alias("offset")).where("offset IS NOT NULL")
        last, reached = reached, materialise(reached.unionByName(further).distinct(), "reached")
        discard(last)
        if i + 1 < rounds:
            second = jumps.select("path", F.col("offset").alias("exit"), F.col("exit").alias("exit2"))
            last, jumps = jumps, materialise(jumps.join(second, ["path", "exit"]).select("path", "offset", F.col("exit2").alias("exit")).where("exit IS NOT NULL"), "jumps")
            discard(last)
    discard(jumps)
    return reached


FIELDS = "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, digest_ok boolean"


def _payload(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header and payload of a block."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, _, payload = block.partition(END)
    return head, payload


def _walked(r: dict, f: pa.NativeFile, with_payload: bool) -> Iterator[dict]:
    """The records of a range from its entry on."""
    base, at = r["entry"], 0
    data = _at(f, base, r["stop"] - base)
    if base and _at(f, base - len(END), len(END)) != END:
        raise ValueError(f"no empty line before offset {base} of {r['path']}")
    while base + at < r["stop"]:
        head = _header(data, at)
        if head is None or head[1] + int(head[0]["content-length"]) + len(END) > len(data):  # goes on after the range
            rest = _head(f, base + at)
            head = _header(rest or b"", 0)
            if rest is not None and head is None:
                raise ValueError(f"no record at offset {base + at} of {r['path']}")
            if head is None or base + at + head[1] + int(head[0]["content-length"]) > r["length"]:
                raise ValueError(f"the end of {r['path']} cuts off the record at offset {base + at}")
            data, base, at = _at(f, base + at, head[1] + int(head[0]["content-length"]) + len(END)), base + at, 0
        fields, body = head
        n = int(fields["content-length"])
        http, payload = _payload(data[body : body + n])
        told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        kind, digest, size = fields.get("warc-type"), told, len(payload)
        if kind == "revisit":
            m = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
            size = int(m[1]) if m else None
        else:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        row = {"path": r["path"], "offset": base + at, "record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "digest_ok": digest == told}
        yield row | ({"payload": payload} if with_payload else {})
        at = body + n + len(END)
        if not END.startswith(data[body + n : at]):
            raise ValueError(f"no empty line before offset {base + at} of {r['path']}")


def walk(cut: DataFrame, starts: DataFrame, size: int, runs: int, with_payload: bool = False) -> DataFrame:
    """The records of each range of that size, from its entry on."""
    starts = starts.select("path", F.floor(F.col("offset") / size).alias("k"), F.col("offset").alias("entry"))
    own = in_runs(cut.join(starts, ["path", "k"]), runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for r, f in _files(batches):
            for row in _walked(r, f, with_payload):
                out.append(row)
                size += len(row.get("payload", b""))
                if len(out) >= 1024 or size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    text = pa.string()
    schema = pa.schema([("path", text), ("offset", pa.int64()), ("record_type", text), ("record_id", text), ("refers_to", text), ("target_uri", text), ("payload_bytes", pa.int64()), ("payload_digest", text), ("digest_ok", pa.bool_())] + [("payload", pa.binary())] * with_payload)
    return own.select("path", "length", "start", "stop", "entry").mapInArrow(run, FIELDS + ", payload binary" * with_payload)


def read(spark: SparkSession, path: str, size: int = RANGE, with_payload: bool = False) -> DataFrame:
    """The true records of all archives under path."""
    cut, runs, most = ranges(spark, path, size)
    found = materialise(candidates(in_runs(cut, runs)), "candidates")
    starts = entries(found, most)
    if most > 1:  # else the entries are read from the candidates
        discard(found)
    return walk(cut, starts, size, runs, with_payload)


def _page(urn: str, kind: DataType) -> Column:
    text = F.regexp_extract(F.col(urn), "page:([^:]*):", 1)
    return F.when(F.col(urn).contains(":page:"), id_value(text, kind))


def round_trip(pages: DataFrame, min_bytes: int = 0, size: int = RANGE, id_col: str = "page_id") -> DataFrame:
    """Writes archives of pages to the shared folder and reads them: identifier, payload, type, response."""
    path = scratch(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    write(pages, path, id_col, min_bytes=min_bytes)
    return read(pages.sparkSession, path, size).select(
        _page("record_id", kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", _page("refers_to", kind).alias("refers_to"), "digest_ok"
    )
