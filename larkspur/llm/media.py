"""Media columns: signature sniffing and carving.

An Aho-Corasick automaton finds all magic bytes in one pass; a validator for each format then walks the structure from
there and confirms it with its length, or refuses. `sniff` corrects a declared type by the format found at the start;
`carve` lists the media embedded anywhere. `store_wave` and `read_wave` keep a payload losslessly as 8-bit samples.

Edge cases: null and empty payloads have no format; a magic without a valid structure, or cut short, is no match; a match
inside another match is not listed (only the outer one is); repeated rows give equal results. For op4, null texts count
as empty and are padded to one block. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 192
RATE = 8000


def _png(d: bytes, at: int) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, pos)
        end = pos + 12 + size
        if end > len(d) or not kind.isalpha() or (first and (kind != b"IHDR" or size != 13)) or zlib.crc32(d[pos + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return 0
        pos, first = end, False
        if kind == b"IEND":
            return pos - at
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    flags = d[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while pos < len(d):
        kind = d[pos]
        if kind == 0x3B:
            return pos + 1 - at
        if kind == 0x2C and pos + 10 <= len(d):
            pos += 11 + (3 << (d[pos + 9] & 7) + 1 if d[pos + 9] & 0x80 else 0)
        elif kind == 0x21:
            pos += 2
        else:
            return 0
        while pos < len(d) and d[pos]:
            pos += 1 + d[pos]
        pos += 1
    return 0


def _jpeg(d: bytes, at: int) -> int:
    pos, scan = at + 2, False
    while pos + 2 <= len(d):
        if d[pos] != 0xFF:
            if not scan:
                return 0
            pos = d.find(b"\xff", pos)
            if pos < 0:
                return 0
            continue
        kind = d[pos + 1]
        if kind == 0xD9:
            return pos + 2 - at if scan else 0
        if kind in (0x00, 0x01, 0xFF) or 0xD0 <= kind <= 0xD7:
            if not scan and kind != 0xFF:
                return 0
            pos += 1 if kind == 0xFF else 2
            continue
        if pos + 4 > len(d):
            return 0
        size = struct.unpack_from(">H", d, pos + 2)[0]
        if size < 2:
            return 0
        scan = scan or kind == 0xDA
        pos += 2 + size
    return 0


def _bmp(d: bytes, at: int) -> int:
    if at + 30 > len(d):
        return 0
    size, reserved, offset, header = struct.unpack_from("<IIII", d, at + 2)
    planes, bits = struct.unpack_from("<HH", d, at + 26) if header >= 40 else struct.unpack_from("<HH", d, at + 22)
    return size if header in (12, 40, 52, 56, 108, 124) and reserved == 0 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= offset <= size <= len(d) - at else 0


def _riff(d: bytes, at: int) -> int:
    if at + 12 > len(d):
        return 0
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if d[at + 8 : at + 12] not in (b"WAVE", b"AVI ", b"WEBP") or end > len(d):
        return 0
    pos = at + 12
    while pos + 8 <= end:
        size = struct.unpack_from("<I", d, pos + 4)[0]
        pos += 8 + size + (size & 1)
    return end - at if pos in (end, end + 1) and pos > at + 12 else 0


def _pdf(d: bytes, at: int, stop: int) -> int:
    """To the last end mark before the next PDF that a valid startxref line comes before: revisions follow the first one."""
    if not d[at + 5 : at + 6].isdigit():
        return 0
    end = d.rfind(b"%%EOF", at, stop)
    while end > at:
        start = d.rfind(b"startxref", at, end)
        if start < 0:
            return 0
        if d[start + 9 : end].strip().isdigit():
            return end + 5 - at
        end = d.rfind(b"%%EOF", at, end)
    return 0


def _zip(d: bytes, at: int) -> int:
    pos = at
    while d[pos : pos + 4] == b"PK\x03\x04" and pos + 30 <= len(d):
        flags, size, name, extra = struct.unpack_from("<H", d, pos + 6)[0], *struct.unpack_from("<I", d, pos + 18), *struct.unpack_from("<HH", d, pos + 26)
        if flags & 8:  # sizes follow the data: look for the directory instead
            pos = d.find(b"PK\x01\x02", pos)
            break
        pos += 30 + name + extra + size
    while 0 <= pos and d[pos : pos + 4] == b"PK\x01\x02" and pos + 46 <= len(d):
        pos += 46 + sum(struct.unpack_from("<HHH", d, pos + 28))
    if pos > at and d[pos : pos + 4] == b"PK\x05\x06" and pos + 22 <= len(d):
        end = pos + 22 + struct.unpack_from("<H", d, pos + 20)[0]
        return end - at if end <= len(d) else 0
    return 0


def _gzip(d: bytes, at: int) -> int:
    engine = zlib.decompressobj(31)
    pos = at
    try:
        while pos < len(d) and not engine.eof:
            engine.decompress(d[pos : pos + 65536])
            pos += 65536
    except zlib.error:
        return 0
    return min(pos, len(d)) - len(engine.unused_data) - at if engine.eof else 0


def _ogg(d: bytes, at: int) -> int:
    pos = at
    while d[pos : pos + 5] == b"OggS\x00" and pos + 27 <= len(d):
        n = d[pos + 26]
        end = pos + 27 + n + sum(d[pos + 27 : pos + 27 + n])
        if end > len(d):
            return 0
        last, pos = d[pos + 5] & 4, end
        if last:
            return pos - at
    return 0


def _mp4(d: bytes, at: int) -> int:
    """at: the box's size, 4 bytes before its magic. Boxes of any type with a printable name count, with sizes of 32 or 64 bits;
    one of size 0 reaches to the end."""
    pos, seen = at, set()
    while pos + 8 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, pos)
        if size == 1 and pos + 16 <= len(d):
            size = struct.unpack_from(">Q", d, pos + 8)[0]
            least = 16
        else:
            least = 8
            size = len(d) - pos if size == 0 and kind == b"mdat" else size
        if not all(0x20 <= c < 0x7F for c in kind) or size < least or pos + size > len(d) or (kind == b"ftyp" and b"ftyp" in seen):
            break
        seen.add(kind)
        pos += size
    return pos - at if b"ftyp" in seen and seen & {b"moov", b"moof"} else 0


#: Magic bytes, how many bytes before them the format starts, media type, validator. Fixed values of the formats.
FORMATS: list[tuple[bytes, int, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"RIFF", 0, "riff", _riff),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"OggS\x00\x02", 0, "application/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}

_automaton = ahocorasick.Automaton()
for _k, _f in enumerate(FORMATS):
    _automaton.add_word(_f[0].decode("latin-1"), _k)
_automaton.make_automaton()


def found(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, length, type) of every valid format in data, in order of start."""
    hits = sorted((end + 1 - len(FORMATS[k][0]) - FORMATS[k][1], k) for end, k in _automaton.iter(data.decode("latin-1")))
    # a PDF ends before the next one's magic, so that all of them together read the data once
    pdfs = [at for at, k in hits if FORMATS[k][3] is _pdf] + [len(data)]
    stops = dict(zip(pdfs, pdfs[1:], strict=False))
    for at, k in hits:
        if at >= 0 and (size := _pdf(data, at, stops[at]) if FORMATS[k][3] is _pdf else FORMATS[k][3](data, at)):
            kind = FORMATS[k][2]
            yield at, size, RIFF_TYPES[data[at + 8 : at + 12]] if kind == "riff" else kind


def inspect(data: bytes | None, declared: str | None = None) -> tuple[str | None, bool, list[tuple[int, int, str]]]:
    """Type of data (the format at its start, else the declared one), whether that corrects the declared type, and the
    media embedded after the start: the outermost of those found inside, or behind, the format at the start."""
    own, inner, reach = None, [], 0
    for at, size, kind in found(data or b""):
        if at == 0 and own is None:
            own = (size, kind)
        elif at >= reach:
            inner.append((at, size, kind))
            reach = at + size
    kind = own[1] if own else declared
    return kind, own is not None and declared is not None and declared.lower() != own[1], inner


def carve(data: bytes | None) -> list[tuple[str, bytes]]:
    return [(kind, data[at : at + size]) for at, size, kind in inspect(data)[2]] if data else []


def store_wave(payload: bytes) -> bytes:
    """A mono wave file of 8-bit samples."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def read_wave(data: bytes) -> tuple[bytes, int, int, int]:
    """Sample bytes, channels, rate and bits of a valid wave file."""
    if not _riff(data, 0) or data[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    pos, fmt = 12, None
    while pos + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, pos)
        if kind == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", data, pos + 8)
        elif kind == b"data" and fmt:
            return data[pos + 8 : pos + 8 + size], fmt[1], fmt[2], fmt[5]
        pos += 8 + size + (size & 1)
    raise ValueError("a wave file without samples")


def media_row(text: bytes) -> tuple:
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; and the stored form."""
    size = max(BLOCK, -(-len(text) // BLOCK) * BLOCK)
    stored = store_wave(text.ljust(size, b" "))
    kind, _, inner = inspect(stored, "application/octet-stream")
    payload, channels, rate, bits = read_wave(stored)
    kinds = ",".join(sorted(k for _, _, k in inner))
    feature = f"{kind};channels={channels};rate={rate};bits={bits};samples={len(payload)};embedded={len(inner)}" + (f":{kinds}" if inner else "")
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


_NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [media_row(x.as_py()) for x in batch["_text"].fill_null("").cast(pa.binary())]
        cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))], names=["doc_id", *_NAMES])


def media_digests(documents: DataFrame) -> DataFrame:
    """The op4 digest."""
    rows = documents.select("doc_id", F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(_texts, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("start", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())])
    for batch in batches:
        kept = [c for c in batch.schema.names if c not in ("_data", "_declared")]
        rows = []
        for data, declared in zip(batch["_data"], batch["_declared"], strict=True):
            data = data.as_py()
            kind, corrected, inner = inspect(data, declared.as_py())
            rows.append((kind, corrected, [{"start": at, "type": k, "bytes": data[at : at + size]} for at, size, k in inner]))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        found_ = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.list_(item)), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *found_], names=[*kept, "media_type", "corrected", "embedded"])


def inspect_media(df: DataFrame, data_col: str, declared_col: str | None = None) -> DataFrame:
    """df with media_type, corrected and embedded (start, type, bytes) for a binary column."""
    kept = [c for c in df.columns if c not in ("media_type", "corrected", "embedded")]
    own = [F.col(c).alias(f"c{k}") for k, c in enumerate(kept)]
    rows = df.select(*own, F.col(data_col).cast("binary").alias("_data"), (F.col(declared_col) if declared_col else F.lit(None)).cast("string").alias("_declared"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_data", "_declared"))
    out = rows.mapInArrow(_inspect, f"{fields}, media_type string, corrected boolean, embedded array<struct<start:long,type:string,bytes:binary>>")
    return out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(kept)})
