"""Packet captures as traces.

A capture is decoded once, by one task a file, packet by packet; only the fields that a specification
names are taken, and written. Packets that cannot be decoded are left out.
"""

from __future__ import annotations

import ipaddress
import re
import socket
import struct
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from streamspec.analysis.checker import Spec
from streamspec.functions.columns import sql_type
from streamspec.sources.trace import Trace, delayed, from_columns
from streamspec.storage import materialise

_U64 = "UInt64"


def _octets(n: int) -> str:
    return "(" + ", ".join([_U64] * n) + ")"


#: The inputs that a capture has, by name, with their types.
FIELDS: dict[str, str] = {
    **{f"Ethernet::{n}": _octets(6) for n in ("source", "destination")}, "Ethernet::type": _U64,
    **{f"IPv4::{n}": _octets(4) for n in ("source", "destination")},
    **{f"IPv4::{n}": _U64 for n in ("ihl", "dscp", "ecn", "length", "identification", "fragment_offset", "ttl", "protocol", "checksum")},
    **{f"IPv4::flags::{n}": "Bool" for n in ("df", "mf")},
    **{f"IPv6::{n}": _octets(16) for n in ("source", "destination")},
    **{f"IPv6::{n}": _U64 for n in ("traffic_class", "flow_label", "length", "hop_limit")},
    **{f"TCP::{n}": _U64 for n in ("source", "destination", "seq_number", "ack_number", "data_offset", "window_size", "checksum", "urgent_pointer")},
    **{f"TCP::flags::{n}": "Bool" for n in ("ns", "fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")},
    **{f"UDP::{n}": _U64 for n in ("source", "destination", "length", "checksum")},
    "payload": "String", "direction": "String", "protocol": "String",
}
_EXTENSIONS = {0, 43, 60, 51, 135}
_VLAN = (0x8100, 0x88A8, 0x9100)


def _bytes(data: bytes) -> dict[str, int]:
    return {f"_{i}": b for i, b in enumerate(data)}


@lru_cache(65_536)
def _direction(target: bytes, local) -> str:
    address = ipaddress.ip_address(target)
    return "Incoming" if address.version == local.version and address in local else "Outgoing"


def decode(frame: bytes, local, wanted: Collection[str] = FIELDS.keys()) -> dict[str, object] | None:
    """The fields of an Ethernet frame that it has; None for a frame that is cut off or malformed.

    local is the network whose addresses make a packet incoming; of addresses, only wanted ones are taken apart.
    """
    try:
        return _decode(frame, local, wanted)
    except (struct.error, IndexError, ValueError):
        return None


def _decode(frame: bytes, local, wanted: Collection[str]) -> dict[str, object]:
    kind = struct.unpack_from("!H", frame, 12)[0]
    out: dict[str, object] = {}

    def addresses(layer: str, source: bytes, target: bytes) -> None:
        if (name := f"{layer}::source") in wanted:
            out[name] = _bytes(source)
        if (name := f"{layer}::destination") in wanted:
            out[name] = _bytes(target)

    addresses("Ethernet", frame[6:12], frame[:6])
    at = 14
    while kind in _VLAN:
        kind = struct.unpack_from("!H", frame, at + 2)[0]
        at += 4
    out["Ethernet::type"], name, target, protocol, end = kind, "Ethernet2", None, None, len(frame)
    if kind == 0x0800:
        first, tos, total, ident, flags, ttl, protocol, check = struct.unpack_from("!BBHHHBBH", frame, at)
        size = (first & 15) * 4
        if first >> 4 != 4 or size < 20 or at + size > len(frame) or total < size:
            raise ValueError
        source, target = frame[at + 12 : at + 16], frame[at + 16 : at + 20]
        addresses("IPv4", source, target)
        out |= {
            "IPv4::ihl": first & 15, "IPv4::dscp": tos >> 2, "IPv4::ecn": tos & 3,
            "IPv4::length": total, "IPv4::identification": ident, "IPv4::fragment_offset": flags & 0x1FFF, "IPv4::ttl": ttl, "IPv4::protocol": protocol,
            "IPv4::checksum": check, "IPv4::flags::df": bool(flags & 0x4000), "IPv4::flags::mf": bool(flags & 0x2000),
        }
        name, end = "IPv4", min(end, at + total)
        at += size
    elif kind == 0x86DD:
        first, length, protocol, hops = struct.unpack_from("!IHBB", frame, at)
        if first >> 28 != 6 or at + 40 > len(frame):
            raise ValueError
        source, target = frame[at + 8 : at + 24], frame[at + 24 : at + 40]
        addresses("IPv6", source, target)
        out |= {
            "IPv6::traffic_class": first >> 20 & 255,
            "IPv6::flow_label": first & 0xFFFFF, "IPv6::length": length, "IPv6::hop_limit": hops,
        }
        name, end = "IPv6", min(end, at + 40 + length) if length else end
        at += 40
        while protocol in _EXTENSIONS:
            protocol, units = frame[at], frame[at + 1]
            at += (units + 2) * 4 if protocol == 51 else (units + 1) * 8
    if protocol == 6:
        src, dst, seq, ack, offset, window, check, urgent = struct.unpack_from("!HHIIHHHH", frame, at)
        size = (offset >> 12) * 4
        if size < 20 or at + size > len(frame):
            raise ValueError
        out |= {
            "TCP::source": src, "TCP::destination": dst, "TCP::seq_number": seq, "TCP::ack_number": ack, "TCP::data_offset": offset >> 12,
            "TCP::window_size": window, "TCP::checksum": check, "TCP::urgent_pointer": urgent,
        }
        for bit, flag in enumerate(("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr", "ns")):
            out[f"TCP::flags::{flag}"] = bool(offset >> bit & 1)
        name = "TCP"
        at += size
    elif protocol == 17:
        src, dst, length, check = struct.unpack_from("!HHHH", frame, at)
        out |= {"UDP::source": src, "UDP::destination": dst, "UDP::length": length, "UDP::checksum": check}
        name = "UDP"
        at += 8
    out["payload"] = frame[at : max(at, end)].decode("utf-8", "replace")
    out["protocol"] = name
    if target is not None:
        out["direction"] = _direction(target, local)
    return out


def packets(read: Callable[[int], bytes]) -> Iterator[tuple[int, bytes]]:
    """Time in nanoseconds and frame of every packet of a capture."""
    head = read(24)
    order = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}.get(head[:4])
    if order is None:
        raise ValueError("no packet capture")
    while len(entry := read(16)) == 16:
        sec, frac, size, _ = struct.unpack(order[0] + "IIII", entry)
        frame = read(size)
        if len(frame) < size:
            return
        yield sec * 10**9 + frac * order[1], frame


def read(spark: SparkSession, path: str, spec: Spec, network: str = "0.0.0.0/0", delay: str | None = None) -> Trace:
    """A trace from a capture, or a folder of captures whose times do not overlap."""
    wrong = [n for n, s in spec.inputs.items() if FIELDS.get(n) != str(s.type)]
    if wrong:
        raise ValueError(f"a capture has no input {', '.join(wrong)} of its type")
    names = list(spec.inputs)
    local = ipaddress.ip_network(network, strict=False)
    schema = StructType.fromDDL("__time bigint, __n bigint, " + ", ".join(f"`{n}` {sql_type(s.type)}" for n, s in spec.inputs.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, wanted = to_arrow_schema(schema), frozenset(names)

        def batch_of(times: list[int], numbers: list[int], rows: list[dict]) -> pa.RecordBatch:
            cells = [[r.get(n) for r in rows] for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([times, numbers, *cells], arrow, strict=True)], schema=arrow)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, name = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                with system.open_input_stream(name, buffer_size=1 << 20) as f:
                    times, numbers, rows = [], [], []
                    for n, (ts, frame) in enumerate(packets(f.read)):
                        fields = decode(frame, local, wanted)
                        if fields is not None:
                            times.append(ts), numbers.append(n), rows.append(fields)
                        if len(rows) == 1024:
                            yield batch_of(times, numbers, rows)
                            times, numbers, rows = [], [], []
                    yield batch_of(times, numbers, rows)

    files = spark.read.format("binaryFile").load(path).select("path")
    made: DataFrame = materialise(files.mapInArrow(run, schema), "packets")
    order = [F.col("__time"), F.col("__n")]
    if delay is not None:
        trace = delayed(made, delay, order)
        return Trace(trace.df.drop("__time", "__n"), trace.start)
    trace = from_columns(made, F.col("__time"), order=order)
    return Trace(trace.df.drop("__time", "__n"), trace.start)


def survey(spark: SparkSession, path: str) -> DataFrame:
    """file, packets and undecodable of each capture: how many frames are there, and how many of them
    are cut off or malformed, so that a trace leaves them out."""
    anywhere = ipaddress.ip_network("0.0.0.0/0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, name = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                with system.open_input_stream(name) as f:
                    good = [decode(frame, anywhere) is not None for _, frame in packets(f.read)]
                yield pa.RecordBatch.from_pydict({"file": [file], "packets": [len(good)], "undecodable": [good.count(False)]})

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "file string, packets long, undecodable long")


def live(interface: str, network: str = "0.0.0.0/0", most: int | None = None) -> Iterator[dict[str, object]]:
    """The fields of packets of a network interface as they pass, from a raw socket of this machine.

    Linux only, and only with the right to open raw sockets. Frames that cannot be decoded are left
    out; most ends the capture after so many packets.
    """
    if not hasattr(socket, "AF_PACKET"):
        raise NotImplementedError("this system has no raw packet sockets: write captures to files and read those")
    local = ipaddress.ip_network(network, strict=False)
    every = 3  # the protocol number of all protocols
    with socket.socket(socket.AF_PACKET, socket.SOCK_RAW, socket.htons(every)) as s:
        s.bind((interface, 0))
        n = 0
        while most is None or n < most:
            fields = decode(s.recv(65_535), local)
            n += 1
            if fields is not None:
                yield fields


def catalogue() -> list[dict]:
    """The inputs of captures and their types."""
    return [{"name": n, "types": [k]} for n, k in FIELDS.items()]
