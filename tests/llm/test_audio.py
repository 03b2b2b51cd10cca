import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import audio


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip(data):
    media = audio.encode_stream(data)
    s = audio.parse_stream(media)
    assert audio.decode_stream(media, s) == data
    assert s.failed == s.skipped == s.resyncs == 0 and s.checked == len(s.offsets) + 1
    assert s.table == "Xing" and s.table_frames == len(s.offsets)
    assert s.samples == 1152 * len(s.offsets)
    assert all(media[a] == 0xFF for a in s.offsets)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_any_bytes_parse(data):
    s = audio.parse_stream(data)
    assert s.skipped <= len(data)


def frame(word, fill=0):
    h = audio.parse_header(word)
    body = bytearray([fill]) * (h.length() - 4)
    return word.to_bytes(4, "big") + bytes(body)


MPEG1_L3_128 = 0xFFFB9044  # 44.1 kHz, joint stereo, no checksum


def test_resynchronises_over_junk():
    f = frame(MPEG1_L3_128)
    data = b"\xff\xfb junk \xff" + f * 3 + b"\xff\xe0\x00garbage" + f * 2
    s = audio.parse_stream(data)
    assert len(s.offsets) == 5 and s.header.rate == 44100 and s.resyncs == 1
    assert s.skipped == len(data) - 5 * len(f)
    assert s.samples == 5 * 1152 and s.seek(1152 * 3) == s.offsets[3] == data.index(b"garbage") + 7


def test_lengths_by_version_and_layer():
    assert audio.parse_header(MPEG1_L3_128).length() == 417
    assert audio.parse_header(0xFFF38044).samples == 576  # MPEG-2 layer III
    assert audio.parse_header(0xFFFF9044).samples == 384  # layer I
    assert audio.parse_header(0xFFE39044).rate == 11025  # MPEG-2.5
    for bad in (0xFFFBF044, 0xFFFB9C44, 0xFFF99044 & ~(3 << 17), 0xFFEB9044, 0x12345678):
        assert audio.parse_header(bad) is None


def test_checksum_is_verified():
    media = bytearray(audio.encode_stream(b"hello world"))
    s = audio.parse_stream(bytes(media))
    media[s.offsets[0] + 8] ^= 1  # side information
    bad = audio.parse_stream(bytes(media))
    assert bad.failed == 1
    with pytest.raises(ValueError):
        audio.decode_stream(bytes(media), bad)


def bitwise_crc(bits):
    crc = 0xFFFF
    for b in bits:
        top = (crc >> 15) ^ b
        crc = (crc << 1) & 0xFFFF
        if top:
            crc ^= 0x8005
    return crc


def test_checksum_against_bitwise_form():
    data = bytes(range(17))
    bits = [(x >> (7 - i)) & 1 for x in data for i in range(8)]
    assert audio.crc16(data, 128) == bitwise_crc(bits[:128])
    assert audio.crc16(data, 131) == bitwise_crc(bits[:131])


def test_layer_one_and_two_checksums():
    for word in (0xFFFE9044, 0xFFFC9004):  # protected layers I and II
        h = audio.parse_header(word)
        body = bytes(h.length() - 6)
        bits = (h.layer == 3 and 4 * (2 * 4 + 28)) or audio._layer2_bits(h, body)
        covered = [(x >> (7 - i)) & 1 for x in word.to_bytes(4, "big")[2:] for i in range(8)] + [0] * bits
        good = word.to_bytes(4, "big") + bitwise_crc(covered).to_bytes(2, "big") + body
        assert audio.check_frame(h, good) is True
        assert audio.check_frame(h, good[:4] + b"\0\0" + body) is False


def test_tags_and_gapless_length():
    text = b"\x03Song"
    tit2 = b"TIT2" + struct.pack(">I", len(text)) + b"\0\0" + text
    id3 = b"ID3\x03\0\0\0\0\0" + bytes([len(tit2)]) + tit2
    f = bytearray(frame(MPEG1_L3_128))
    xing = b"Info" + struct.pack(">III", 3, 4, 2000) + b"LAME3.100" + bytes(12) + ((576 << 12) | 1000).to_bytes(3, "big")
    f[36 : 36 + len(xing)] = xing
    v1 = b"TAG" + b"Old title".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(65)
    s = audio.parse_stream(id3 + bytes(f) + frame(MPEG1_L3_128) * 4 + v1)
    assert s.tags == {"TIT2": "Song", "TPE1": "Artist"}
    assert (s.table, s.table_frames, s.table_bytes, s.delay, s.end_padding) == ("Info", 4, 2000, 576, 1000)
    assert s.samples == 4 * 1152 - 1576 and s.skipped == 0


def test_free_format():
    head = (MPEG1_L3_128 & ~(15 << 12)).to_bytes(4, "big")
    s = audio.parse_stream((head + bytes(300)) * 4)
    assert len(s.offsets) == 4 and set(s.lengths) == {304}


def test_query_digests(spark, hard, empty):
    rows = audio.digest_audio(audio.encode_audio(hard)).collect()
    texts = [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()]
    assert len(rows) == len(texts)
    want = sorted(
        (str(i), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        for i, t in texts
        for b in [(t or "").encode()]
        for p in [b + bytes((-len(b)) % 64 if b else 64)]
    )
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert audio.digest_audio(audio.encode_audio(empty)).count() == 0


def test_probe_columns(spark):
    media = spark.createDataFrame([(1, audio.encode_stream(b"abc")), (2, None), (3, b"")], "doc_id bigint, media binary")
    rows = {r["doc_id"]: r for r in audio.probe_audio(media, with_payload=True).collect()}
    assert rows[1]["payload"] == b"abc" and rows[1]["frames"] == 1 and rows[1]["samples"] == 1152
    assert rows[2]["frames"] == rows[3]["frames"] == 0 and rows[2]["frame_offsets"] == []


def test_unsynchronised_tags():
    text = b"\x00a\xff\xe0b"  # holds what looks like a header, so it is stored with a zero between
    for major, flags, form in ((3, 0x80, 0), (4, 0, 0x02), (4, 0, 0x03)):
        stored = (len(text).to_bytes(4, "big") if form & 1 else b"") + text.replace(b"\xff", b"\xff\x00")
        size = len(text) if major == 3 else len(stored)
        tag = b"TIT2" + struct.pack(">I", size) + bytes((0, form)) + stored
        s = audio.parse_stream(b"ID3" + bytes((major, 0, flags, 0, 0, 0, len(tag))) + tag + frame(MPEG1_L3_128) * 3)
        assert s.tags == {"TIT2": "a\xff\xe0b"} and len(s.offsets) == 3 and s.skipped == 0, (major, form)


def test_vbri_table():
    f = bytearray(frame(MPEG1_L3_128))
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 50, 2000, 4, 3, 2, 2, 1) + struct.pack(">3H", 417, 200, 300)
    f[36 : 36 + len(table)] = table
    s = audio.parse_stream(bytes(f) + frame(MPEG1_L3_128) * 4)
    assert (s.table, s.table_bytes, s.table_frames, s.table_step) == ("VBRI", 2000, 4, 1)
    assert s.table_points == [834, 1234, 1834] and len(s.offsets) == 4


def plain_frames(media):
    """(offset, length) of the frames behind the first tag, by the formula of the standard alone."""
    at = 10 + sum((media[6 + i] & 127) << 7 * (3 - i) for i in range(4))
    kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    out = []
    while at < len(media):
        assert media[at] == 0xFF and media[at + 1] & 0xFE == 0xFA
        size = 144 * 1000 * kbps[media[at + 2] >> 4] // [44100, 48000, 32000][media[at + 2] >> 2 & 3] + (media[at + 2] >> 1 & 1)
        out.append((at, size))
        at += size
    return out


def test_query_against_an_independent_reading(spark, documents, texts):
    from tessella.llm.queries import op1_mpeg_audio

    rows = {r["doc_id"]: r for r in op1_mpeg_audio(spark, "/root/testdata/sf0.001").collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in audio.encode_audio(documents).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        frames = plain_frames(media[i])[1:]  # the first is the table
        assert rows[i]["frame_offsets"] == [a for a, _ in frames] and rows[i]["frames"] == len(frames)
        assert rows[i]["samples"] == 1152 * len(frames) and rows[i]["sample_rate"] == 32000
        body = (t or "").encode()
        payload = b"".join(media[i][a + 23 : a + n] for a, n in frames)[: rows[i]["payload_bytes"]]
        assert payload == body + bytes(rows[i]["payload_bytes"] - len(body)) and rows[i]["n_bytes"] == len(body)
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and rows[i]["media_sha256"] == hashlib.sha256(media[i]).hexdigest()


def test_query_digests_in_one_pass(spark, documents, hard, empty):
    """No stream leaves the worker that built it; the values are those of the two steps one after the other."""
    from tessella.llm.queries import QUERIES

    plan = QUERIES["op1_mpeg_audio"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    for df in (documents, hard, empty):
        apart = audio.digest_audio(audio.encode_audio(df))
        once = audio.digest_texts(df)
        assert once.schema == apart.schema
        assert sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))
