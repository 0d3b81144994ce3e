"""Operator 6, media columns: signature sniffing, structure validation, type correction and carving.

A media column holds a binary and a declared type.  Aho-Corasick finds all formats' magic bytes in one pass; a validator for each
format walks the structure there (chunks, segments, boxes, checksums, lengths) and returns its length or nothing.  What is valid at
byte 0 corrects the declared type; what is valid further on, and not inside what was found before, is embedded and can be carved.

The query stores each text, padded to rows of 192 bytes, in a Parquet table in the shared folder as one of five kinds of media, by the text's checksum:
an 8-bit grey PNG of that width, an 8-bit mono WAV, an 8-bit BMP, a gzip member, or a PNG within other bytes.  Some are declared rightly, some as
another type or as octets.  The table is read back, ``carve`` corrects types and finds what is embedded, and the samples are decoded from the carved bytes.

Defined cases: a null text is the empty one; a null binary has no type and no segments; equal bytes give equal results; other columns
pass through ``carve``, whose own get underscores where their names are taken.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdclens.llm import _store as S

ROW = 192


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int | None:
        while p < len(b):
            n = b[p]
            p += 1 + n
            if not n:
                return p
        return None

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
        if p is None:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, scans = at + 2, 0
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0xD9:
            return p + 2 - at if scans else None
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or kind in (0x00, 0x01) or 0xD0 <= kind <= 0xD8:
            return None
        p += 2 + n
        if kind == 0xDA:
            scans += 1
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" and scans else None


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b):
        return None
    n = struct.unpack_from("<I", b, at + 4)[0]
    end = at + 8 + n
    if n < 4 or end > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    p = at + 12
    while p + 8 <= end:
        p += 8 + (struct.unpack_from("<I", b, p + 4)[0] + 1) // 2 * 2
    return end - at if p in (end, end + 1) else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    n, zero, offset, header, _w, _h, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    ok = zero == 0 and header in (12, 40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= offset < n <= len(b) - at
    return n if ok else None


def _gzip(b: bytes, at: int) -> int | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:
            rest = b[p : p + 65536]
            d.decompress(rest, 1 << 20)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += len(rest)
    except zlib.error:
        return None
    return p - len(d.unused_data) - at if d.eof else None


_TURNED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def _ogg_sum(page: bytes) -> int:
    """The CRC of polynomial 04C11DB7, highest bit first, from nothing: zlib's over turned bytes, turned."""
    return int(f"{zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _ogg(b: bytes, at: int) -> int | None:
    p = at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b):
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if b[p + 4] or p + 27 + n > len(b) or p + size > len(b):
            return None
        if _ogg_sum(b[p : p + 22] + bytes(4) + b[p + 26 : p + size]) != struct.unpack_from("<I", b, p + 22)[0]:
            return None
        p += size
        if b[p - size + 5] & 4:
            return p - at
    return None


def _boxes(b: bytes, at: int) -> int | None:
    """ISO base media; the magic is four bytes into the first box."""
    p = start = at - 4
    if start < 0:
        return None
    seen = set()
    while p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if n < 8 or p + n > len(b) or not all(0x20 <= c < 0x7F for c in kind):
            break
        seen.add(kind)
        p += n
    return p - start if b"moov" in seen or b"mdat" in seen or b"meta" in seen else None


#: Magic bytes, type, validator, bytes before the magic.
SIGNATURES: list[tuple[bytes, str, Callable[[bytes, int], int | None], int]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png, 0),
    (b"GIF87a", "image/gif", _gif, 0),
    (b"GIF89a", "image/gif", _gif, 0),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg, 0),
    (b"RIFF", "riff", _riff, 0),
    (b"BM", "image/bmp", _bmp, 0),
    (b"\x1f\x8b\x08", "application/gzip", _gzip, 0),
    (b"OggS", "application/ogg", _ogg, 0),
    (b"ftyp", "video/mp4", _boxes, 4),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}

_found: ahocorasick.Automaton | None = None


def _automaton() -> ahocorasick.Automaton:
    global _found
    if _found is None:
        _found = ahocorasick.Automaton()
        for k, (magic, *_) in enumerate(SIGNATURES):
            _found.add_word(magic.decode("latin-1"), (k, len(magic)))
        _found.make_automaton()
    return _found


def segments(b: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid media in b, outermost only, in order."""
    out: list[tuple[int, int, str]] = []
    end = 0
    for last, (k, n) in _automaton().iter(b.decode("latin-1")):
        at = last - n + 1
        _, kind, valid, before = SIGNATURES[k]
        if at - before < end:
            continue
        size = valid(b, at)
        if size:
            out.append((at - before, size, RIFF_TYPES[b[at + 8 : at + 12]] if kind == "riff" else kind))
            end = at - before + size
    return out


_SEGMENTS = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))


def carve(media: DataFrame, column: str = "media", declared: str = "declared", into: tuple[str, str] = ("type", "segments")) -> DataFrame:
    """The rows with ``type`` (the declared one, corrected) and ``segments`` (offset, length, type, bytes) added, under other names if those are taken."""
    names = S.names(media, *into)

    def of(batches):
        for batch in batches:
            kinds, found = [], []
            for b, d in zip(batch.column(column).to_pylist(), batch.column(declared).to_pylist()):
                s = segments(b) if b else []
                kinds.append(s[0][2] if s and s[0][0] == 0 else d)
                found.append([{"offset": o, "length": n, "type": t, "bytes": b[o : o + n]} for o, n, t in s])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string()), pa.array(found, _SEGMENTS)], names=[*batch.schema.names, *names])

    from pyspark.sql.types import StructType

    added = StructType.fromDDL("a string, b array<struct<offset:bigint,length:bigint,type:string,bytes:binary>>").fields
    for f, name in zip(added, names):
        f.name = name
    S.arrow_batches(media.sparkSession)
    return media.mapInArrow(of, StructType(media.schema.fields + added))


def payload(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def to_png(data: bytes) -> bytes:
    """8-bit grey, ROW samples wide, no row filters."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + chunk(b"IEND", b"")


def from_png(b: bytes) -> tuple[bytes, int, int]:
    """(samples, width, height) of what to_png wrote."""
    p, data = 8, []
    while p < len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", b, p + 8)
        elif kind == b"IDAT":
            data.append(b[p + 8 : p + 8 + n])
        p += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if depth != 8 or colour or lines[:, 0].any():
        raise ValueError("not an unfiltered 8-bit grey image")
    return lines[:, 1:].tobytes(), width, height


def to_wav(data: bytes) -> bytes:
    """8-bit mono at 8 kHz; a payload is of even length, so no chunk is padded."""
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(b: bytes) -> tuple[bytes, int, int]:
    p = 12
    while p < len(b):
        kind, n = struct.unpack_from("<4sI", b, p)
        if kind == b"fmt " and struct.unpack_from("<HHIIHH", b, p + 8)[::5] != (1, 8):
            raise ValueError("not 8-bit samples")
        if kind == b"data":
            return b[p + 8 : p + 8 + n], n, 1
        p += 8 + (n + 1) // 2 * 2
    raise ValueError("no samples")


_GREY = b"".join(bytes((x, x, x, 0)) for x in range(256))


def to_bmp(data: bytes) -> bytes:
    """8 bits a dot with a grey palette; rows of ROW bytes need no padding and go from the top down, as the height is negative."""
    offset = 54 + len(_GREY)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", offset + len(data), 0, offset, 40, ROW, -(len(data) // ROW), 1, 8, 0, len(data), 2835, 2835, 256, 0) + _GREY + data


def from_bmp(b: bytes) -> tuple[bytes, int, int]:
    offset, _, width, height, _, depth = struct.unpack_from("<IIiiHH", b, 10)
    if depth != 8 or height >= 0:
        raise ValueError("not an 8-bit image from the top down")
    return b[offset : offset - width * height], width, -height


def from_gzip(b: bytes) -> tuple[bytes, int, int]:
    data = zlib.decompress(b, 31)
    return data, len(data), 1


def _gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


DECODERS = {"image/png": from_png, "audio/wav": from_wav, "image/bmp": from_bmp, "application/gzip": from_gzip}


def stored(data: bytes) -> tuple[bytes, str]:
    """A payload as media and the type it is declared as, which is right for some."""
    k = zlib.crc32(data)
    kind, said = k % 5, (k >> 8) % 3
    if kind == 4:  # within other bytes, in which there is no magic
        return b"\x00" * (1 + (k >> 16) % 64) + to_png(data) + b"\x00" * 7, ("application/octet-stream", "image/png", "text/plain")[said]
    made = (to_png, to_wav, to_bmp, _gzipped)[kind](data)
    return made, (list(DECODERS)[kind], list(DECODERS)[(kind + 1) % 4], "application/octet-stream")[said]


def _write(batches):
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        made = [stored(payload(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([d for _, d in made], pa.string()), pa.array([m for m, _ in made], pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])


def _read(batches):
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for b, said, kind, found in zip(*(batch.column(c).to_pylist() for c in ("media", "declared", "type", "segments"))):
            (one,) = found
            data, width, height = DECODERS[one["type"]](one["bytes"])
            v = np.frombuffer(data, dtype=np.uint8)
            out["payload_bytes"].append(len(data))
            out["payload_sha256"].append(hashlib.sha256(data).hexdigest())
            out["tail_crc32"].append(zlib.crc32(data[-16:]))
            out["media_bytes"].append(len(b))
            out["media_sha256"].append(hashlib.sha256(b).hexdigest())
            out["feature"].append(f"{said}>{kind} {one['type']}@{one['offset']}+{one['length']} {width}x{height} mean={v.mean():.4f} max={int(v.max())}")
        types = {k: pa.int64() if k in ("payload_bytes", "tail_crc32", "media_bytes") else pa.string() for k in out}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, types[k]) for k, v in out.items())], names=["doc_id", "n_bytes", *out])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    S.arrow_batches(spark)
    docs = S.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = S.table(docs.mapInArrow(_write, f"doc_id {kind}, n_bytes long, declared string, media binary"), "media")
    return carve(kept).mapInArrow(_read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
