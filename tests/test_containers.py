"""Structure of binary files: whole, cut and changed samples of every kind."""

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from tempora.functions import containers as K
from tempora.operators import checks


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def bitwise(data, poly, width):
    crc = 0
    for byte in data:
        crc ^= byte << (width - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc >> (width - 1) else crc << 1) & ((1 << width) - 1)
    return crc


def flac_frame(number, body):
    head = b"\xff\xf8\x69\x08" + chr(number).encode() + b"\x0f"  # eight bits of block size follow
    head += bytes([bitwise(head, 0x07, 8)])
    return head + body + struct.pack(">H", bitwise(head + body, 0x8005, 16))


def tiff(order):
    mark = {"<": b"II*\0", ">": b"MM\0*"}[order]
    entries = [(256, 3, 1, 2), (273, 4, 1, 8), (279, 4, 1, 6)]
    body = struct.pack(order + "H", len(entries))
    for tag, kind, n, value in entries:
        body += struct.pack(order + "HHI", tag, kind, n) + struct.pack(order + ("HH" if kind == 3 else "I"), *((value, 0) if kind == 3 else (value,)))
    return mark + struct.pack(order + "I", 14) + b"pixels" + body + struct.pack(order + "I", 0)


def pdf():
    one = b"%PDF-1.4\n"
    two = b"1 0 obj\n<< /Type /Catalog >>\nendobj\n"
    table = b"xref\n0 2\n0000000000 65535 f \n%010d 00000 n \ntrailer\n<< /Size 2 /Root 1 0 R >>\n" % len(one)
    return one + two + table + b"startxref\n%d\n%%%%EOF\n" % len(one + two)


SAMPLES = {
    "png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"pixel")) + chunk(b"IEND", b""),
    "gif": b"GIF89a\1\0\1\0\x80\0\0" + bytes(6) + b"\x21\xf9\4\0\0\0\0\0" + b"\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0\x3b",
    "jpg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\3x\1\xff\0\2\xff\xd0\3\xff\xd9",
    "flac": b"fLaC\x80\0\0\x22" + bytes(17) + b"\x30" + bytes(16) + flac_frame(0, b"abc\xff\xf8def") + flac_frame(200, b"x" * 77) + flac_frame(3000, b""),
    "tiff": tiff("<"),
    "bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 24, 0, 54, 40, 3, 2, 1, 24, 0, 24, 0, 0, 0, 0) + bytes(24),
    "pdf": pdf(),
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_whole_files_pass_and_cut_ones_do_not(kind):
    data = SAMPLES[kind]
    assert K.fault_of(data, kind) is None
    least = {"pdf": 6}.get(kind, 1)  # a PDF may lose the line end behind its last mark
    for n in range(len(data) - least + 1):
        assert K.fault_of(data[:n], kind), (kind, n)


def test_other_byte_order_and_wrong_places():
    assert K.fault_of(tiff(">"), "TIFF") is None
    assert K.fault_of(SAMPLES["pdf"].replace(b"1 0 obj", b"2 0 obj"), "pdf") == "object 1 is not in its place"
    loop = tiff("<")[:-4] + struct.pack("<I", 14)
    assert K.fault_of(loop, "tiff") == "directories in a circle"
    assert K.fault_of(SAMPLES["gif"], "png") == "no png signature"
    assert K.fault_of(None, "png") == "unreadable"
    assert K.fault_of(b"", "txt") is None and K.fault_of(b"", None) is None


@pytest.mark.parametrize("kind, start", [("png", 0), ("flac", 42)])
def test_any_changed_bit_is_seen_where_checksums_are(kind, start):
    data = SAMPLES[kind]
    for at in range(start, len(data)):
        for bit in range(8):
            assert K.fault_of(data[:at] + bytes([data[at] ^ 1 << bit]) + data[at + 1:], kind), (at, bit)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=40))
def test_folded_checksums_equal_bitwise_ones(left, right):
    assert K._crc16(left) == bitwise(left, 0x8005, 16)
    assert K._after(K._crc16(left), len(right)) ^ K._crc16(right) == K._crc16(left + right)
    assert K._crc8(left) == bitwise(left, 0x07, 8)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(SAMPLES)), st.binary(max_size=60), st.integers(0, 200), st.integers(0, 20))
def test_no_content_crashes_a_walk(kind, junk, at, drop):
    data = SAMPLES[kind]
    K.fault_of(data[:at] + junk + data[at + drop:], kind)
    K.fault_of(data[:8] + junk, kind)


def test_results_of_a_table_of_files(spark):
    df = spark.createDataFrame(
        [(k, bytearray(v)) for k, v in SAMPLES.items()] + [("png", bytearray(SAMPLES["png"][:-3])), ("txt", bytearray(b"")),
                                                           ("jpg", None), (None, None)],
        "file_extension string, content binary")
    got = rows(checks.check_content(df), "file_extension", "val_state", "val_error")
    assert got == sorted([(k, 1, None) for k in SAMPLES] + [("png", 2, "cut off"), ("txt", None, None),
                                                            ("jpg", 2, "unreadable"), (None, None, None)], key=repr)
    assert checks.check_content(df.limit(0)).count() == 0
    heads = df.select("file_extension", checks.has_magic(F.col("content"), F.col("file_extension")).alias("ok"))
    assert {r for r in rows(heads) if r[1] is not None} == {(k, True) for k in SAMPLES}
