import hashlib
import math
import struct

from pyspark.sql import functions as F

from gustline.functions import binary, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_integers_of_every_width(spark):
    data = bytearray([0xC3, 0xA9, 0x03, 0xFF, 0x80])
    for width in (1, 2, 3, 4):
        for offset in (0, 1):
            part = bytes(data[offset : offset + width])
            for endian in ("little", "big"):
                got = one(spark, binary.unsigned_int(F.col("b"), offset, width, endian), b=data)
                assert got == int.from_bytes(part, endian)
                got = one(spark, binary.signed_int(F.col("b"), offset, width, endian), b=data)
                assert got == int.from_bytes(part, endian, signed=True)
    assert one(spark, binary.unsigned_int(F.col("b"), 3, 4), b=data) is None


def test_float32_covers_all_kinds_of_value(spark):
    for bits in (0, 1 << 31, 1, 0x007FFFFF, 0x3FC00000, 0xC2F6E979, 0x7F7FFFFF, 0x7F800000, 0xFF800000, 0x7FC00000):
        raw = struct.pack("<I", bits)
        got, want = one(spark, binary.float32(F.col("b"), 0), b=bytearray(raw)), struct.unpack("<f", raw)[0]
        assert (math.isnan(got) and math.isnan(want)) or got == want


def test_whole_payload_and_back(spark):
    assert one(spark, binary.whole_unsigned(F.col("b")), b=bytearray([2, 1])) == 258
    assert one(spark, binary.whole_unsigned(F.col("b")), b=bytearray()) is None
    for size in (6, 7, 8, 240):
        assert one(spark, binary.whole_unsigned(F.col("b")), b=bytearray([2, 1] + [0] * (size - 2))) == 258
        assert one(spark, binary.whole_unsigned(F.col("b"), "big"), b=bytearray([0] * (size - 2) + [1, 2])) == 258
    assert one(spark, binary.whole_unsigned(F.col("b")), b=bytearray([1] * 7)) == int("01" * 7, 16)
    assert one(spark, binary.whole_unsigned(F.col("b")), b=bytearray([0] * 7 + [1])) is None
    assert bytes(one(spark, binary.little_endian_bytes(F.col("n"), 4), n=305419896)) == bytes.fromhex("78563412")


def test_slugs(spark):
    assert one(spark, text.slugify(F.col("s")), s="My Installation_1") == "my-installation-1"
    assert one(spark, text.is_slug(F.col("s")), s="not slugified") is False
    assert one(spark, text.is_slug(F.col("s")), s="a-b1") is True


def test_location_needs_both_coordinates_and_puts_latitude_first(spark):
    assert one(spark, text.point_wkt(F.col("a"), F.col("b")), a=1.5, b=2.0) == (
        "POINT (1.5000000000000000 2.0000000000000000)"
    )
    assert one(spark, text.point_wkt(F.col("a"), F.col("b")), a=0.0, b=1.0) is None


def test_content_hash_of_section_text(spark):
    document = '{"nodes": {"0": {"blah": "blah"}}, "gateway": {"stuff": "data"}}'
    section = lambda name: text.content_hash(text.json_section(F.col("d"), F.lit(name)))
    assert one(spark, section("nodes"), d=document) == (
        "1aea08f4603f76a55d3267dd40c310e14787a8d64663a72cfc62f58152e44504"
    )
    assert one(spark, section("gateway"), d=document) == (
        "6076cf0f824bcf1a887a96c75c1a33ec720ea271776f03e8168df3feed983c91"
    )


def test_times_and_paths(spark):
    got = one(spark, text.posix_to_timestamp(F.col("t")).cast("string"), t=1636559720.639327)
    assert got == "2021-11-10 15:55:20.639327"
    assert one(spark, text.session_name(F.timestamp_seconds(F.lit(0)))) == "19700101T000000"
    assert one(spark, text.window_path(F.lit("out/s"), F.lit(3))) == "out/s/window-3.json"
    assert one(spark, text.microphone_path(F.lit("a.b/window-3.json"), F.lit("7"))) == (
        "microphone/window_id=" + hashlib.sha256(b"a.b/window-3.json").hexdigest()[:16] + "/node_id=7"
    )
    assert one(spark, text.if_truthy_text(F.lit(""))) is None
    assert one(spark, text.if_truthy_number(F.lit(0.0))) is None
