"""WARC archives and MPEG audio: round trips, damage, literal frames."""

import hashlib
import io
import os
import random
import zlib
from fractions import Fraction

import pytest
import zstandard

from gleaner.llm import mpeg_audio, queries, warc


def archive(records, dictionary=b"WARC/1.1 some dictionary text " * 10):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc.dictionary_frame(dictionary) + b"".join(packer.compress(r) for r in records)


def test_frames_need_their_dictionary():
    records = [warc.record("response", i, f"http://a/{i}", os.urandom(i * 3000), "A" * 32) for i in range(40)]
    assert list(warc.frames(io.BytesIO(archive(records)))) == records
    whole = archive(records)
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(whole[:-5])))
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(whole + b"garbage")))
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(whole[whole.index(b"\x28\xb5\x2f\xfd", 20) :])))
    raw = zstandard.ZstdCompressor().compress(records[1])
    assert list(warc.frames(io.BytesIO(raw))) == [records[1]] and list(warc.frames(io.BytesIO(b""))) == []


@pytest.mark.parametrize("content", [b"garbage", b"", b"\x28\xb5\x2f\xfd garbage", zstandard.ZstdCompressor().compress(b"text " * 99)[:-4], zstandard.ZstdCompressor().compress(b"text " * 99) + b"x", b"\x37\xa4\x30\xec broken"])
def test_dictionaries_that_cannot_be_read(content):
    record = warc.record("response", 1, "http://a/", b"x", "A" * 32)
    data = (0x184D2A5D).to_bytes(4, "little") + len(content).to_bytes(4, "little") + content + zstandard.ZstdCompressor().compress(record)
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(data)))


def test_a_common_payload(spark, tmp_path):
    pages = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id % 2 = 0 THEN 'same' ELSE concat('page ', id) END AS html")
    rows = warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "w"))).collect()
    assert sorted(r["page_id"] for r in rows) == list(range(3000))
    assert {(r["record_type"], r["refers_to"]) for r in rows if r["page_id"] % 2 == 0 and r["page_id"] != 2998} == {("revisit", 2998)}
    assert all(r["record_type"] == "response" for r in rows if r["page_id"] % 2 or r["page_id"] == 2998)


def test_headers_and_lengths():
    good = warc.record("response", 5, "http://a/ b", b"body", warc.base32_sha1(b"body"))
    headers, block = warc.parse_record(good)
    assert headers["warc-target-uri"] == "http://a/%20b" and block.endswith(b"\r\n\r\nbody")
    for bad in (good.replace(b"WARC/1.1", b"HTTP/1.1"), good[:-1], good + b"x", good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"body\r\n", b"bodi\r\n")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_payloads_come_back(spark, sf_dir, tmp_path):
    pages = queries.table(spark, sf_dir, "pages")
    rows = warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "w"))).collect()
    html = dict(pages.select("page_id", "html").collect())
    assert len(rows) == len(html)
    assert all(bytes(r["payload"]).decode() == html[r["page_id"]] for r in rows if r["record_type"] == "response")
    assert all(html[r["page_id"]] == html[r["refers_to"]] for r in rows if r["record_type"] == "revisit")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 900, 937, 938, 960, 40_000])
def test_payload_round_trip(n):
    raw = random.Random(n).randbytes(n)
    data = mpeg_audio.pack(raw)
    s = mpeg_audio.scan(data)
    assert mpeg_audio.unpack(data) == mpeg_audio.padded(raw) and not s.skipped and s.checked == len(s.offsets)
    assert s.table["frames"] == len(s.offsets) and s.duration == Fraction(1152 * len(s.offsets), 48000)
    assert all(mpeg_audio.parse_header(data[o : o + 4]) for o in s.offsets)
    assert mpeg_audio.seek(s.offsets, s.rate, 1152, 0.0) == s.offsets[0] and mpeg_audio.seek(s.offsets, s.rate, 1152, 1e6) is None


def test_false_sync_words_inside_payload():
    raw = bytes([0xFF, 0xFA, 0xE4, 0xC0]) * 3000
    assert mpeg_audio.unpack(mpeg_audio.pack(raw)) == mpeg_audio.padded(raw)


def test_damage_is_seen_and_passed():
    data = mpeg_audio.pack(random.Random(1).randbytes(6000))
    clean = mpeg_audio.scan(data)
    o = clean.offsets[2]
    torn = mpeg_audio.scan(data[:o] + b"\x00junk\xff\xfb\x00" + data[o:])
    assert torn.skipped == 8 and torn.resyncs == 1 and len(torn.offsets) == len(clean.offsets)
    flipped = bytearray(data)
    flipped[o + 8] ^= 1
    assert mpeg_audio.scan(bytes(flipped)).bad_checksums == 1
    with pytest.raises(ValueError):
        mpeg_audio.unpack(bytes(flipped))
    assert mpeg_audio.scan(b"").duration == 0 and mpeg_audio.scan(b"no audio at all").skipped == 15


def test_other_headers_and_tags():
    assert mpeg_audio.parse_header(b"\xff\xfb\x90\x00").size == 417 and mpeg_audio.parse_header(b"\xff\xfb\x92\x00").size == 418
    assert mpeg_audio.parse_header(b"\xff\xf3\x90\x00").samples == 576 and mpeg_audio.parse_header(b"\xff\xff\x90\x00").layer == 1
    assert mpeg_audio.parse_header(b"\xff\xfb\xf0\x00") is None and mpeg_audio.parse_header(b"\xff\xe9\x90\x00") is None
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    tag = b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    s = mpeg_audio.scan(frame * 5 + tag)
    assert len(s.offsets) == 5 and s.tags["v1:title"] == "Title" and s.duration == Fraction(5 * 1152, 44100)
    vbri = frame[:36] + b"VBRI" + bytes([0, 1, 0, 0, 0, 75]) + (2085).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 2, 0, 1]) + bytes([0, 9, 0, 8])
    s = mpeg_audio.scan(vbri.ljust(417, b"\0") + frame * 4)
    assert s.table["kind"] == "VBRI" and s.table["toc"] == [9, 8] and len(s.offsets) == 4
    lame = bytearray(frame)
    lame[36:40], lame[43] = b"Info", 0
    lame[44:48] = b"LAME"
    lame[65:68] = (576 << 12 | 100).to_bytes(3, "big")
    s = mpeg_audio.scan(bytes(lame) + frame * 3)
    assert s.table["delay"] == 576 and s.duration == Fraction(3 * 1152 - 676, 44100)


@pytest.mark.parametrize("word", ["TAG", "ID3", "LAME", "Xing", "Info", "VBRI", "\xff\xfb"])
def test_marks_of_tags_inside_payload(word):
    for lead in ("", "x", "xx"):
        for n in [*range(0, 70), 301, 999, 2999]:
            raw = (lead + word * n).encode("latin-1")
            assert mpeg_audio.unpack(mpeg_audio.pack(raw)) == mpeg_audio.padded(raw)
    tag = b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    s = mpeg_audio.scan(mpeg_audio.pack(b"TAG" * 21) + tag)
    assert s.tags["v1:title"] == "Title" and not s.skipped and s.table["frames"] == len(s.offsets)


def plain_crc(bits):
    crc = 0xFFFF
    for bit in bits:
        crc = crc << 1 ^ (0x8005 if crc >> 15 ^ bit else 0)
        crc &= 0xFFFF
    return crc


def bits_of(raw):
    return [b >> 7 - k & 1 for b in raw for k in range(8)]


@pytest.mark.parametrize(
    "head, body, covered",
    [
        (b"\xff\xfe\x80\xc0", b"\x12\x34" * 8, 128),  # Layer I, mono: 32 allocations of 4 bits
        (b"\xff\xfe\x80\x00", b"\x12\x34" * 16, 256),  # stereo: twice as many
        (b"\xff\xfe\x80\x50", b"\x12\x34" * 12, 160),  # joint stereo from subband 8 on: 2 * 8 + 24 allocations
        (b"\xff\xfc\x44\xc0", bytes(11), 88),  # Layer II, mono at 48 kHz: 11 * 4 + 12 * 3 + 4 * 2, none used
        (b"\xff\xfc\x44\xc0", b"\x10" + bytes(10), 90),  # one subband used: 2 bits more
        (b"\xff\xf4\x84\xc0", b"\x11" + bytes(10), 79),  # half the rates: 4 * 4 + 7 * 3 + 19 * 2, two used
    ],
)
def test_checksums_of_layers_one_and_two(head, body, covered):
    parsed = mpeg_audio.parse_header(head)
    crc = plain_crc((bits_of(head[2:] + body.ljust(60, b"\0")))[: 16 + covered])
    frame = (head + crc.to_bytes(2, "big") + body).ljust(parsed.size, b"\0")
    s = mpeg_audio.scan(frame * 3)
    assert (s.checked, s.bad_checksums, len(s.offsets)) == (3, 0, 3)
    torn = bytearray(frame * 3)
    torn[parsed.size + 6] ^= 0x80
    assert mpeg_audio.scan(bytes(torn)).bad_checksums == 1


def test_free_format_and_delay():
    frame = b"\xff\xfb\x00\x00".ljust(700, b"\x55")
    s = mpeg_audio.scan(frame * 6)
    assert s.offsets == [700 * k for k in range(5)] + [3500] and s.sizes == [700] * 6 and s.duration == Fraction(6 * 1152, 44100)
    vbri = (b"\xff\xfb\x90\x00" + bytes(32) + b"VBRI" + bytes([0, 1, 4, 0, 0, 75]) + bytes(8) + bytes(8)).ljust(417, b"\0")
    s = mpeg_audio.scan(vbri + (b"\xff\xfb\x90\x00" + bytes(413)) * 4)
    assert s.table["delay"] == 1024 and s.duration == Fraction(4 * 1152 - 1024, 44100)


def test_scanning_noise_takes_time_in_proportion():
    for noise in (b"\xff" * 300_000, b"ID3" * 100_000, b"\xff\xfb\x00" * 100_000, b"TAG" * 100_000):
        assert mpeg_audio.scan(noise).bad_checksums == 0


def test_every_column_of_the_audio_query(spark, sf_dir):
    texts = dict(queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    rows = queries.op1_mpeg_audio(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    media = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stream = mpeg_audio.pack(raw)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
        # 320 kbit/s at 48 kHz is 960 bytes a frame, 23 of them header, checksum and side information.
        n = -(-len(payload) // 937)
        assert r["feature"].startswith(f"Xing {n} frames, 48000 Hz, {Fraction(n * 1152, 48000).numerator}/{Fraction(n * 1152, 48000).denominator} s, crc {n}/{n}, seek ")
        assert media.setdefault(r["media_sha256"], r["feature"]) == r["feature"]
