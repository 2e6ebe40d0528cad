"""Structural checks of binary files: is every part of the container where its headers say it is?

Nothing is decoded.  Each check walks the blocks of one file and returns the first fault found, or
None.  What the walks see: cut files, faulty lengths and offsets, and changed bytes wherever the
format carries checksums (PNG, FLAC) or structure (the others).  Changed picture data of a GIF, JPEG,
TIFF or BMP that keeps the structure is not seen.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of a TIFF value by its type.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CUT = "cut off"


def png_fault(data: bytes) -> str | None:
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        return "no png signature"
    at, seen = 8, set()
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        if end > len(data):
            return CUT
        if not seen and (kind != b"IHDR" or size != 13):
            return "no image header"
        if zlib.crc32(data[at + 4:end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return f"checksum at {at}"
        seen.add(kind)
        if kind == b"IEND":
            return None if b"IDAT" in seen else "no image data"
        at = end
    return CUT


def _sub_blocks(data: bytes, at: int) -> int:
    """Behind a chain of length-prefixed blocks; beyond the end where it is cut."""
    while at < len(data) and data[at]:
        at += data[at] + 1
    return at + 1


def gif_fault(data: bytes) -> str | None:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        return "no gif signature"
    if len(data) < 13:
        return CUT
    flags = data[10]
    at = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    images = 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return None if images else "no image data"
        if kind == 0x21:
            at = _sub_blocks(data, at + 2)
        elif kind == 0x2C:
            if at + 11 > len(data):
                return CUT
            flags = data[at + 9]
            at = _sub_blocks(data, at + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
            images += 1
        else:
            return f"unknown block at {at}"
    return CUT


def jpeg_fault(data: bytes) -> str | None:
    if not data.startswith(b"\xff\xd8"):
        return "no jpeg signature"
    at, scans = 2, 0
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            return f"no marker at {at}"
        kind = data[at + 1]
        if kind == 0xFF:  # fill byte
            at += 1
        elif kind == 0xD9:
            return None if scans else "no image data"
        elif at + 4 > len(data):
            return CUT
        else:
            size = struct.unpack_from(">H", data, at + 2)[0]
            if size < 2:
                return f"faulty length at {at}"
            at += 2 + size
            if kind == 0xDA:
                scans += 1
                mark = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S).search(data, at)
                if mark is None:
                    return CUT
                at = mark.start()
    return CUT


def _byte_crcs(poly: int, width: int) -> np.ndarray:
    """CRC of every byte value."""
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << width) - 1)
    return out.astype(np.uint32)


def _crc8(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc = int(CRC8[crc ^ byte])
    return crc


def _moved(crc, steps: np.ndarray):
    """CRCs moved on over zero bytes; ``steps`` has the images of the low and the high byte."""
    return steps[0][crc & 255] ^ steps[1][crc >> 8]


def _crc16(data: bytes) -> int:
    """All bytes' CRCs, folded in halves: of two neighbours the left one is moved over the right."""
    part = CRC16[np.frombuffer(data, np.uint8)]
    for level in range(max(0, len(part) - 1).bit_length()):
        if len(part) % 2:
            part = np.concatenate([np.zeros(1, np.uint32), part])
        part = _moved(part[0::2], MOVES[level]) ^ part[1::2]
    return int(part[0]) if len(part) else 0


def _after(crc: int, size: int) -> int:
    """A CRC moved over ``size`` zero bytes."""
    for level in range(size.bit_length()):
        if size >> level & 1:
            crc = int(_moved(np.uint32(crc), MOVES[level]))
    return crc


def _moves(levels: int) -> list[np.ndarray]:
    """Images of the low and the high byte after 1, 2, 4, ... zero bytes."""
    # over one zero byte the high byte is looked up and the low one moves up
    out = [np.stack([np.arange(256, dtype=np.uint32) << 8, CRC16])]
    for _ in range(levels - 1):
        out.append(np.stack([_moved(out[-1][0], out[-1]), _moved(out[-1][1], out[-1])]))
    return out


CRC8 = _byte_crcs(0x07, 8)
CRC16 = _byte_crcs(0x8005, 16)
MOVES = _moves(40)


def _flac_samples(data: bytes, at: int) -> int:
    """Samples of the frame whose header, with its right checksum, stands here; 0 where none does."""
    if at + 5 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return 0
    size, rate = data[at + 2] >> 4, data[at + 2] & 15
    if size == 0 or rate == 15 or data[at + 3] >> 4 > 10 or data[at + 3] & 1:
        return 0
    lead = data[at + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()  # bytes behind the number's first
    place, wide = at + 5 + more, {6: 1, 7: 2}.get(size, 0)
    end = place + wide + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(data) or _crc8(data[at:end]) != data[end]:
        return 0
    if wide:
        return int.from_bytes(data[place:place + wide], "big") + 1
    return 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8


def flac_fault(data: bytes) -> str | None:
    if not data.startswith(b"fLaC"):
        return "no flac signature"
    at, last, first = 4, False, True
    while not last:
        if at + 4 > len(data):
            return CUT
        last, kind, size = data[at] >= 0x80, data[at] & 0x7F, int.from_bytes(data[at + 1:at + 4], "big")
        if first and (kind != 0 or size != 34):
            return "no stream header"
        first, at = False, at + 4 + size
    if at >= len(data):
        return CUT
    frames = {m.start(): n for m in re.compile(rb"(?=\xff[\xf8\xf9])", re.S).finditer(data, at)
              if (n := _flac_samples(data, m.start()))}
    starts = list(frames)
    if not starts or starts[0] != at:
        return f"no frame at {at}"
    # a frame ends where its checksum comes out as zero; a false start inside it is passed over
    begin, crc, samples = at, 0, 0
    for here, end in zip(starts, starts[1:] + [len(data)]):
        crc = _after(crc, end - here) ^ _crc16(data[here:end])
        if crc == 0:
            samples += frames[begin]
            begin = end
    if begin < len(data):
        return f"frame at {begin}"
    promised = int.from_bytes(data[18:26], "big") & (1 << 36) - 1  # 0: unknown
    return CUT if samples < promised else None


def tiff_fault(data: bytes) -> str | None:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        return "no tiff signature"
    if len(data) < 8:
        return CUT
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            return "directories in a circle"
        seen.add(at)
        if at + 2 > len(data):
            return CUT
        count = struct.unpack_from(order + "H", data, at)[0]
        if at + 6 + 12 * count > len(data):
            return CUT
        values: dict[int, tuple[int, ...]] = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = TIFF_SIZES.get(kind, 1) * n
            place = at + 10 + 12 * i
            if size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            if place + size > len(data):
                return CUT
            if tag in (273, 279) and kind in (3, 4):  # strip offsets and strip sizes
                values[tag] = struct.unpack_from(f"{order}{n}{'H' if kind == 3 else 'I'}", data, place)
        if any(o + s > len(data) for o, s in zip(values.get(273, ()), values.get(279, ()))):
            return CUT
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
    return None if seen else "no directory"


def bmp_fault(data: bytes) -> str | None:
    if not data.startswith(b"BM"):
        return "no bmp signature"
    if len(data) < 54:
        return CUT
    size, pixels, header, width, height = struct.unpack_from("<I4xIIii", data, 2)
    bits, packed = struct.unpack_from("<HI", data, 28)
    if header < 40 or pixels < 14 + header:
        return "faulty header"
    need = (width * bits + 31) // 32 * 4 * abs(height) if packed == 0 else 0
    return CUT if max(size, pixels + need) > len(data) else None


def pdf_fault(data: bytes) -> str | None:
    if b"%PDF-" not in data[:1024]:
        return "no pdf signature"
    if b"%%EOF" not in data[-1024:]:
        return CUT
    starts = re.findall(rb"startxref\s+(\d+)", data[-2048:])
    if not starts:
        return "no cross-reference"
    at = int(starts[-1])
    if re.compile(rb"\s*\d+\s+\d+\s+obj").match(data, at):
        return None  # a cross-reference stream, which is packed
    table = re.compile(rb"\s*xref\s+").match(data, at)
    if table is None:
        return "no cross-reference"
    at = table.end()
    head = re.compile(rb"(\d+)\s+(\d+)\s*?\r?\n?")
    while part := head.match(data, at):
        at = part.end()
        for n in range(int(part[1]), int(part[1]) + int(part[2])):
            entry = re.compile(rb"\s*(\d{10}) (\d{5}) ([nf])\s*").match(data, at)
            if entry is None:
                return f"cross-reference of object {n}"
            at = entry.end()
            if entry[3] == b"n" and not re.compile(rb"\s*%d\s+%d\s+obj" % (n, int(entry[2]))).match(data, int(entry[1])):
                return f"object {n} is not in its place"
    return None if data.startswith(b"trailer", at) else "no trailer"


FAULTS: dict[str, Callable[[bytes], str | None]] = {
    "png": png_fault, "gif": gif_fault, "jpg": jpeg_fault, "jpeg": jpeg_fault, "flac": flac_fault,
    "tiff": tiff_fault, "bmp": bmp_fault, "pdf": pdf_fault,
}


def fault_of(content: bytes | None, extension: str | None) -> str | None:
    """First fault of one file: None also for kinds without a check, "unreadable" for null content."""
    check = FAULTS.get((extension or "").lower())
    if check is None:
        return None
    return "unreadable" if content is None else check(bytes(content))


@F.pandas_udf(T.StringType())
def _faults(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for content, extension in batches:
        yield pd.Series([fault_of(c, e) for c, e in zip(content, extension)], dtype=object)


def content_fault(content: Column, extension: Column) -> Column:
    """First structural fault of binary content by its extension, null where there is none.

    Files reach Python in Arrow batches, so a task holds a batch of files: set
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` (or ``maxBytesPerBatch``) low for large ones.
    """
    return _faults(content, extension)
