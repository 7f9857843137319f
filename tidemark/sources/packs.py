"""Binary point packs: varint-delimited protobuf messages, compressed frames, and their inverse.

Decoding needs Python (there is no built-in for it); it runs on Arrow batches, a
corrupt pack gives one error row and no points.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECODED_DDL = (
    "batch_id BIGINT, metric STRING, tags MAP<STRING,STRING>, ts INT, value_type STRING, int_value BIGINT, "
    "float_value FLOAT, int_list ARRAY<BIGINT>, float_list ARRAY<FLOAT>, error STRING"
)
#: Wire types of the fields of a point (fixed values).
WIRE = {1: (2,), 2: (0,), 3: (2,), 4: (0,), 5: (0,), 6: (5,), 7: (0, 2), 8: (2, 5)}
KINDS = ("INT", "FLOAT", "INT_LIST", "FLOAT_LIST")


def put_varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while True:
        low, n = n & 0x7F, n >> 7
        if not n:
            out.append(low)
            return bytes(out)
        out.append(low | 0x80)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated number")
        byte = data[at]
        at += 1
        n |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return n, at


def signed(n: int) -> int:
    return n - 2**64 if n >= 2**63 else n


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of one message."""
    at = 0
    while at < len(data):
        tag, at = get_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = get_varint(data, at)
        elif kind == 2:
            size, at = get_varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        if at > len(data):
            raise ValueError("truncated message")
        yield tag >> 3, kind, value


def _delimited(field: int, body: bytes) -> bytes:
    return put_varint(field << 3 | 2) + put_varint(len(body)) + body


def encode_point(p: dict) -> bytes:
    """One message: 1 metric, 2 timestamp, 3 attributes, 4 kind, 5 integer, 6 float, 7 integers, 8 floats."""
    out = _delimited(1, p["metric"].encode()) + put_varint(2 << 3) + put_varint(p["ts"])
    for k, v in sorted(p["tags"].items()):
        out += _delimited(3, _delimited(1, k.encode()) + _delimited(2, v.encode()))
    out += put_varint(4 << 3) + put_varint(KINDS.index(p["value_type"]))
    if p.get("int_value") is not None:
        out += put_varint(5 << 3) + put_varint(p["int_value"])
    if p.get("float_value") is not None:
        out += put_varint(6 << 3 | 5) + struct.pack("<f", p["float_value"])
    for v in p.get("int_list") or []:
        out += put_varint(7 << 3) + put_varint(v)
    for v in p.get("float_list") or []:
        out += put_varint(8 << 3 | 5) + struct.pack("<f", v)
    return out


def encode_pack(points: list[dict], batch_id: int | None = None) -> bytes:
    """Length-delimited messages, with an 8-byte batch id in front if given."""
    head = struct.pack(">q", batch_id) if batch_id is not None else b""
    return head + b"".join(put_varint(len(m)) + m for m in map(encode_point, points))


def decode_point(data: bytes) -> dict:
    p: dict = {"metric": None, "ts": None, "tags": {}, "value_type": None, "int_value": None, "float_value": None, "int_list": [], "float_list": []}
    for field, kind, v in fields(data):
        if kind not in WIRE.get(field, (kind,)):
            raise ValueError(f"field {field} has wire type {kind}")
        if field == 1:
            p["metric"] = v.decode()
        elif field == 2:
            p["ts"] = signed(v)
        elif field == 3:
            pair = {f: x.decode() for f, k, x in fields(v) if k == 2}
            p["tags"][pair[1]] = pair[2]
        elif field == 4:
            p["value_type"] = KINDS[v]
        elif field == 5:
            p["int_value"] = signed(v)
        elif field == 6:
            p["float_value"] = struct.unpack("<f", v)[0]
        elif field == 7 and kind == 2:  # packed
            at = 0
            while at < len(v):
                n, at = get_varint(v, at)
                p["int_list"].append(signed(n))
        elif field == 7:
            p["int_list"].append(signed(v))
        elif field == 8 and kind == 2:
            p["float_list"] += struct.unpack(f"<{len(v) // 4}f", v)
        elif field == 8:
            p["float_list"].append(struct.unpack("<f", v)[0])
    if p["metric"] is None or p["ts"] is None or p["value_type"] is None or not 0 <= p["ts"] < 2**31:
        raise ValueError("a required field is missing or out of range")
    for name in ("int_list", "float_list"):
        p[name] = p[name] if p["value_type"] == name.upper() else None
    return p


def decode_pack(data: bytes, *, with_batch_id: bool = False) -> tuple[int | None, list[dict]]:
    batch, at = None, 0
    if with_batch_id:
        if len(data) < 8:
            raise ValueError("truncated batch id")
        (batch,), at = struct.unpack_from(">q", data), 8
    out = []
    while at < len(data):
        size, at = get_varint(data, at)
        if at + size > len(data):
            raise ValueError("truncated message")
        out.append(decode_point(data[at : at + size]))
        at += size
    return batch, out


def inflate(data: bytes, *, most: int = 1 << 28) -> tuple[bytes, bytes]:
    """(content, what follows) of one whole zlib, gzip or raw deflate stream, with a bound on the content."""
    raw_first = not (data[:1] == b"\x78" or data[:2] == b"\x1f\x8b")
    problem = "no deflate stream"
    for bits in ((-15, 47) if raw_first else (47, -15)):
        stream = zlib.decompressobj(bits)
        try:
            out = stream.decompress(data, most)
        except zlib.error:
            continue
        if stream.unconsumed_tail:
            raise ValueError("content beyond the bound")
        if stream.eof:
            return out, stream.unused_data
        problem = "truncated stream"
    raise ValueError(problem)


def inflate_all(data: bytes, *, most: int = 1 << 28) -> bytes:
    """Content of streams that follow one another up to the end of the data."""
    out = bytearray()
    while data:
        content, data = inflate(data, most=most - len(out))
        out += content
    return bytes(out)


def unsnap(block: bytes) -> bytes:
    """One snappy block: literals and back references."""
    size, at = get_varint(block, 0)
    out = bytearray()
    while at < len(block):
        tag = block[at]
        at += 1
        if tag & 3 == 0:
            length = (tag >> 2) + 1
            if length > 60:
                extra = length - 60
                length, at = int.from_bytes(block[at : at + extra], "little") + 1, at + extra
            out += block[at : at + length]
            at += length
            continue
        if tag & 3 == 1:
            length, offset, at = (tag >> 2 & 7) + 4, (tag >> 5) << 8 | block[at], at + 1
        else:
            width = 2 if tag & 3 == 2 else 4
            length, offset, at = (tag >> 2) + 1, int.from_bytes(block[at : at + width], "little"), at + width
        if not 0 < offset <= len(out):
            raise ValueError("bad back reference")
        for _ in range(length):
            out.append(out[-offset])
    if len(out) != size:
        raise ValueError("length differs")
    return bytes(out)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc_table()


def masked_crc(data: bytes) -> int:
    """CRC-32C of the data, turned and shifted as snappy frames carry it."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = _CRC[(crc ^ byte) & 0xFF] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def unsnap_frames(data: bytes, *, most: int = 1 << 28) -> bytes:
    """Content of a framed snappy stream; checksums must hold, padding is skipped."""
    out, at = bytearray(), 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("truncated frame")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body, at = data[at + 4 : at + 4 + size], at + 4 + size
        if at > len(data):
            raise ValueError("truncated frame")
        if kind in (0, 1):
            content = unsnap(body[4:]) if kind == 0 else body[4:]
            if masked_crc(content) != int.from_bytes(body[:4], "little"):
                raise ValueError("checksum differs")
            out += content
        elif 2 <= kind <= 0x7F:
            raise ValueError(f"frame kind {kind}")
        if len(out) > most:
            raise ValueError("content beyond the bound")
    return bytes(out)


#: Frames of compressed lines within a line stream: the command and the size in bytes of what follows its line.
FRAME = re.compile(rb"^(deflate|snappy) +(\d+)[ \t\r]*$")


def stream_lines(data: bytes, *, most: int = 1 << 28) -> Iterator[tuple[str | None, str | None]]:
    """(line, error) of a recorded line stream, its compressed frames opened in place.

    A line may begin in one frame and end in the next or in plain text.  A frame that
    is cut short or corrupt is one error, and reading goes on behind it.
    """
    at, carried = 0, b""
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line, at = data[at:end], end + 1
        found = FRAME.match(line)
        if found is None:
            yield (carried + line).decode("utf-8", "replace"), None
            carried = b""
            continue
        size = int(found[2])
        body, at = data[at : at + size], at + size
        try:
            if len(body) < size:
                raise ValueError("truncated frame")
            content = inflate_all(body, most=most) if found[1] == b"deflate" else unsnap_frames(body, most=most)
        except (ValueError, IndexError) as e:
            carried = b""
            yield None, str(e)
            continue
        *whole, carried = (carried + content).split(b"\n")
        yield from ((x.decode("utf-8", "replace"), None) for x in whole)
    if carried:
        yield carried.decode("utf-8", "replace"), None


def open_streams(files: DataFrame, *, column: str = "content", most: int = 1 << 28, rows: int = 10_000) -> DataFrame:
    """``line, frame_error`` of recorded line streams, one per row of ``files``; lines in order within a stream."""

    def kernel(batches):
        for batch in batches:
            for data in batch.column(0):
                held = []
                for pair in stream_lines(data.as_py() or b"", most=most):
                    held.append(pair)
                    if len(held) >= rows:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.string()) for k in (0, 1)], names=["line", "frame_error"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.string()) for k in (0, 1)], names=["line", "frame_error"])

    return files.select(F.col(column).cast("binary").alias("content")).mapInArrow(kernel, "line STRING, frame_error STRING")


def decode_packs(packs: DataFrame, *, column: str = "value", compression: str | None = None, with_batch_id: bool = True, most: int = 1 << 28, rows: int = 20_000) -> DataFrame:
    """Points of binary packs; a corrupt pack is one row with ``error``.  compression: None, deflate or snappy.

    ``most``: bytes that one pack may hold when it is open; beyond, it is an error.
    """
    if compression not in (None, "deflate", "snappy"):
        raise ValueError(f"unknown compression {compression!r}")
    schema = pa.schema(
        [
            ("batch_id", pa.int64()), ("metric", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("ts", pa.int32()), ("value_type", pa.string()),
            ("int_value", pa.int64()), ("float_value", pa.float32()), ("int_list", pa.list_(pa.int64())), ("float_list", pa.list_(pa.float32())), ("error", pa.string()),
        ]
    )

    def kernel(batches):
        for batch in batches:
            held = []
            for data in batch.column(0):
                if (data := data.as_py()) is None:
                    continue
                try:
                    data = inflate_all(data, most=most) if compression == "deflate" else unsnap_frames(data, most=most) if compression == "snappy" else data
                    number, points = decode_pack(data, with_batch_id=with_batch_id)
                    held += [p | {"batch_id": number, "tags": list(p["tags"].items()), "error": None} for p in points]
                except (ValueError, KeyError, IndexError, UnicodeDecodeError, struct.error) as e:
                    held.append(dict.fromkeys(schema.names) | {"error": str(e) or type(e).__name__})
                if len(held) >= rows:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return packs.select(F.col(column).cast("binary").alias("value")).mapInArrow(kernel, DECODED_DDL)


def encode_packs(points: DataFrame, *, batch_column: str = "batch_id") -> DataFrame:
    """One pack per batch: ``batch_id, value`` (a batch is bounded by its producer)."""

    def pack(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        number = rows[0]["batch_id"]
        for r in rows:
            r["tags"] = dict(r["tags"])
        return pa.table({"batch_id": pa.array([number], pa.int64()), "value": pa.array([encode_pack(rows, number)], pa.binary())})

    wire = points.select(F.col(batch_column).alias("batch_id"), "metric", "tags", "ts", "value_type", "int_value", "float_value", "int_list", "float_list")
    return wire.where("metric is not null and tags is not null and value_type is not null").groupBy("batch_id").applyInArrow(pack, "batch_id BIGINT, value BINARY")
