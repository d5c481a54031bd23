"""The binary shard file: header, payloads, index, footer. Pure Python, no Spark.

Fixed values, little-endian. Header: DES2, version, three zero bytes. Footer: DESI, index
size as 64 bits. Index: number of entries as 32 bits, then entries. An entry starts with
its uid (16-bit length, UTF-8). Version 2 goes on with a flag byte: 0 for an inline entry
(offset, length, codec byte, compressed and full size, 32-bit length of JSON notes, notes),
1 for one out of line (16-bit length and SHA-256 in hex, size, notes as before). Version 1
has inline entries without flags and notes. Writers make version 2.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterable
from typing import BinaryIO

import pyarrow as pa

MAGIC, INDEX_MAGIC, VERSIONS = b"DES2", b"DESI", (1, 2)
HEADER, FOOTER = 8, 12
CODECS = {"none": 0, "zstd": 1, "lz4": 2}
NAMES = {v: k for k, v in CODECS.items()}
#: Profile -> codec and level; a codec without a profile has level 3.
PROFILES = {"aggressive": ("zstd", 9), "balanced": ("zstd", 5), "speed": ("lz4", None)}
BIG = "_bigFiles"


def packed(data: bytes, codec: str, level: int | None = 3) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level or 3).compress(data)
    if codec == "lz4":  # frames
        return pa.Codec("lz4").compress(data, asbytes=True)
    if codec != "none":
        raise ValueError(f"codec {codec} is not available")
    return data


def unpacked(data: bytes, codec: str, size: int) -> bytes:
    try:
        if codec == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        elif codec == "lz4":
            data = pa.Codec("lz4").decompress(data, decompressed_size=size, asbytes=True)
    except Exception as e:
        raise ValueError("the payload does not decompress") from e
    if len(data) != size:
        raise ValueError("size differs after decompression")
    return data


def _notes(meta: dict | None) -> bytes:
    return json.dumps(meta, separators=(",", ":")).encode() if meta else b""


class Writer:
    """Writes a shard to a stream, one payload at a time. Payloads above the threshold go to `spill(digest, data)`; without finish() the file has no footer."""

    def __init__(self, out: BinaryIO, threshold: int | None = None, spill: Callable[[str, bytes], None] | None = None, codec: str = "zstd", level: int | None = 5):
        self.out, self.threshold, self.spill, self.codec, self.level = out, threshold, spill, codec, level
        self.index: list[bytes] = []
        self.seen: set[str] = set()
        self.at = HEADER
        self.big: set[str] = set()
        out.write(MAGIC + bytes([2]) + bytes(3))

    def add(self, uid: str, data: bytes, meta: dict | None = None, compress: bool = True) -> None:
        if uid in self.seen:
            raise ValueError(f"{uid} is there already")
        self.seen.add(uid)
        name, notes = uid.encode(), _notes(meta)
        head = struct.pack("<H", len(name)) + name
        tail = struct.pack("<I", len(notes)) + notes
        if self.threshold is not None and len(data) > self.threshold:
            digest = hashlib.sha256(data).hexdigest()
            if digest not in self.big:
                self.spill(digest, data)
                self.big.add(digest)
            self.index.append(head + struct.pack("<BH", 1, len(digest)) + digest.encode() + struct.pack("<Q", len(data)) + tail)
            return
        codec = self.codec if compress else "none"
        body = packed(data, codec, self.level)
        self.out.write(body)
        self.index.append(head + struct.pack("<BQQBQQ", 0, self.at, len(body), CODECS[codec], len(body), len(data)) + tail)
        self.at += len(body)

    def finish(self) -> int:
        """Writes index and footer; the size of the file."""
        table = struct.pack("<I", len(self.index)) + b"".join(self.index)
        self.out.write(table + INDEX_MAGIC + struct.pack("<Q", len(table)))
        return self.at + len(table) + FOOTER


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str):
        kind = "<" + kind
        n = struct.calcsize(kind)
        if self.at + n > len(self.data):
            raise ValueError("the index is truncated")
        self.at += n
        return struct.unpack_from(kind, self.data, self.at - n)

    def sized(self, kind: str) -> bytes:
        return self.take(f"{self.take(kind)[0]}s")[0]

    def notes(self) -> dict:
        meta = json.loads(self.sized("I") or b"{}")
        if not isinstance(meta, dict):
            raise ValueError("notes must be a mapping")
        return meta


def check_header(header: bytes) -> int:
    """The version."""
    if len(header) != HEADER or header[:4] != MAGIC or header[4] not in VERSIONS or header[5:] != bytes(3):
        raise ValueError("not a shard of a known version")
    return header[4]


def index_range(footer: bytes, size: int) -> tuple[int, int]:
    """Offset and length of the index."""
    if len(footer) != FOOTER or footer[:4] != INDEX_MAGIC:
        raise ValueError("the footer is missing")
    (length,) = struct.unpack("<Q", footer[4:])
    if size - FOOTER - length < HEADER:
        raise ValueError("the index is larger than the file")
    return size - FOOTER - length, length


def parse_index(data: bytes, end: int, version: int) -> dict[str, dict]:
    """uid -> entry; `end` is where payloads end. Of a uid that repeats the last entry counts."""
    c, out = _Cursor(data), {}
    for _ in range(c.take("I")[0]):
        uid = c.sized("H").decode()
        if version == 2 and c.take("B")[0] & 1:
            digest = c.sized("H").decode()
            (size,) = c.take("Q")
            out[uid] = {"is_bigfile": True, "bigfile_hash": digest, "size": size, "meta": c.notes()}
            continue
        offset, length, codec, body, size = c.take("QQBQQ")
        meta = c.notes() if version == 2 else {}
        if codec not in NAMES:
            raise ValueError(f"unknown codec {codec}")
        if offset < HEADER or offset + length > end:
            raise ValueError("an entry lies outside the data")
        out[uid] = {"is_bigfile": False, "codec": NAMES[codec], "offset": offset, "length": length, "compressed_size": body, "size": size, "meta": meta}
    return out


def fetch_index(ranges: Callable[[int, int], bytes], size: int) -> dict[str, dict]:
    """The index by three range reads: header, footer, index."""
    if size < HEADER + FOOTER:
        raise ValueError("not a shard: too short")
    version = check_header(ranges(0, HEADER))
    at, length = index_range(ranges(size - FOOTER, FOOTER), size)
    return parse_index(ranges(at, length), at, version)


def fetch(ranges: Callable[[int, int], bytes], entry: dict, big: Callable[[str], bytes] | None = None) -> bytes:
    """An entry's payload by one more range read, or from the store of big files."""
    if entry["is_bigfile"]:
        if big is None:
            raise ValueError("the entry is out of line")
        data = big(entry["bigfile_hash"])
        if len(data) != entry["size"]:
            raise ValueError("the big file has another size")
        return data
    return unpacked(ranges(entry["offset"], entry["length"]), entry["codec"], entry["size"])


def write(entries: Iterable[tuple[str, bytes, dict | None]], threshold: int | None = None, codec: str = "zstd", level: int | None = 5, compress=lambda uid: True) -> tuple[bytes, dict[str, bytes]]:
    """(shard, big files by SHA-256) in memory."""
    out, big = pa.BufferOutputStream(), {}
    w = Writer(out, threshold, big.__setitem__, codec, level)
    for uid, data, meta in entries:
        w.add(uid, data, meta, compress(uid))
    w.finish()
    return out.getvalue().to_pybytes(), big


def within(shard: bytes) -> Callable[[int, int], bytes]:
    """Range reads of a shard in memory."""
    return lambda offset, length: shard[offset : offset + length]


def read_index(shard: bytes) -> dict[str, dict]:
    return fetch_index(within(shard), len(shard))


def read(shard: bytes, uid: str, big: dict[str, bytes] | None = None) -> bytes:
    return fetch(within(shard), read_index(shard)[uid], big.__getitem__ if big is not None else None)
