"""Bit codes, parameter sets, messages and configuration records against literal vectors; cut and random payloads never crash."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitlake.functions import headers
from bitlake.operators import parameters


def test_bits():
    b = headers.Bits(bytes([0b10101010, 0b11001100]))
    assert [b.u(3), b.u(5), b.flag(), b.u(7)] == [5, 10, True, 76]
    codes = "1" + "010" + "011" + "00100" + "00101"
    data = int(codes.ljust(24, "0"), 2).to_bytes(3, "big")
    b = headers.Bits(data)
    assert [b.ue() for _ in range(5)] == [0, 1, 2, 3, 4]
    b = headers.Bits(data)
    assert [b.se() for _ in range(5)] == [0, 1, -1, 2, -2]
    assert headers.Bits(b"\x80").te(1) == 0 and headers.Bits(b"\x40").te(5) == 1
    with pytest.raises(ValueError, match="exp-golomb overflow"):
        headers.Bits(bytes(20)).ue()
    with pytest.raises(ValueError, match="end of bitstream"):
        headers.Bits(b"").u(1025)
    left = headers.Bits(b"\xb0\x00")  # 101 and the stop bit
    assert [left.more() or left.u(1) for _ in range(1)] == [True]
    left.u(3)
    assert not left.more()


def test_configuration():
    good = bytes([1, 0x42, 0, 0x1E, 0xFF, 0xE1, 0, 4, 0x67, 0x42, 0, 0x1E, 1, 0, 2, 0x68, 0xCE])
    assert headers.configuration(good) == {"length_size": 4, "sps": [b"\x67\x42\x00\x1e"], "pps": [b"\x68\xce"]}
    for data, reason in ((good[:2], "too short"), (b"\x02" + good[1:], "configurationVersion"), (good[:4] + b"\xfe" + good[5:], "lengthSizeMinusOne"), (good[:7], "SPS length"), (good[:10], "SPS data"), (good[:12], "PPS count"), (good[:14], "PPS length"), (good[:16], "PPS data")):
        with pytest.raises(ValueError, match=reason):
            headers.configuration(data)


def test_messages():
    long = bytes([255, 10, 255, 1]) + bytes(256)
    assert headers.messages(bytes([5, 18]) + bytes(range(18)) + long + b"\x80\x00") == [(5, bytes(range(16)), b"\x10\x11"), (265, None, bytes(256))]
    for data, reason in ((b"\x05\x03abc", "too short"), (b"\xff", "payload type"), (b"\x01\xff", "payload size"), (b"\x01\x09a", "exceeds")):
        with pytest.raises(ValueError, match=reason):
            headers.messages(data)


def test_scaling_list():
    code = "".join("0" * (len(f"{k + 1:b}") - 1) + f"{k + 1:b}" for k in (1, 0, 22))  # 9, 9, then -11 for 254
    data = int((code + "1").ljust(24, "0"), 2).to_bytes(3, "big")
    assert headers.scaling_list(headers.Bits(data), 3) == [9, 9, 254]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_random_payloads_give_fields_or_reasons(data):
    for read in (headers.sequence_set, headers.picture_set, headers.slice_start, headers.messages, headers.configuration):
        try:
            read(data)
        except ValueError as e:
            assert str(e)


def test_tables_keep_errors(spark):
    units = [(1, 0, 3, 7, bytearray(b"\x42\x00\x1e\x00\x00\x00\x00\x00")), (1, 1, 3, 8, None), (1, 2, 1, 1, bytearray(b"\x00")), (1, 3, 0, 6, bytearray(b"\x80")), (None, 4, 3, 7, bytearray())]
    df = spark.createDataFrame(units, "stream_id long, unit_no long, ref_idc int, unit_type int, payload binary").withColumn("sps", F.lit("clash"))
    assert {r.stream_id: bool(r.error) for r in parameters.sequence_sets(df).collect()} == {1: True, None: True}
    assert [bool(r.error) for r in parameters.picture_sets(df).collect()] == [True]
    assert [r.error for r in parameters.slice_headers(df.drop("sps")).collect()] == ["exp-golomb overflow"]
    assert parameters.side_messages(df).count() == 0
    names = df.select(parameters.unit_type_name(F.col("unit_type")).alias("n")).distinct().collect()
    assert {r.n for r in names} == {"Sps", "Pps", "Slice", "Sei"}
    assert df.limit(1).select(parameters.unit_type_name(F.lit(20)).alias("n")).first().n == "Other(20)"
