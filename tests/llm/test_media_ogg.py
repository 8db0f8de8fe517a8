import hashlib
import random
import zlib

import pytest

from larkspur.llm import media_ogg


def crc(data):
    value = 0
    for b in data:
        value ^= b << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
    return value


def test_checksum_is_the_named_polynomial():
    rng = random.Random(0)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert media_ogg.page_checksum(data) == crc(data)


@pytest.mark.parametrize("n", [64, 255, 4000, 4001, 7999, 8000, 8001, 255 * 255, 300_000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = media_ogg.encode(payload)
    back, found = media_ogg.decode(media)
    assert back == payload and found["ms"] == n * 1000 // media_ogg.RATE and found["streams"] == 2
    assert len(media) < n * 1.03 + 300


@pytest.mark.parametrize("size", [1, 254, 255, 510, 64_770, 65_025, 65_026, 200_000])
def test_packets_of_any_size_survive_paging(size):
    packets = [(0, b"head"), (size, b"x" * size), (size + 3, b"abc"), (size + 3, b"")]
    media = b"".join(p for _, p in media_ogg.write_pages(7, packets))
    streams, _ = media_ogg.demultiplex(media)
    assert [d for _, d in streams[7].packets] == [d for _, d in packets]
    assert streams[7].packets[-1][0] == size + 3


def test_damage_is_found():
    media = media_ogg.encode(b"q" * 9000)
    for at in (0, 30, 100, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(media_ogg.OggError):
            media_ogg.decode(bytes(bad))
    first = media.index(b"OggS", 4)
    for broken in (media[:-5], media[first:], media[:first] + media[media.index(b"OggS", first + 4) :]):
        with pytest.raises(media_ogg.OggError):
            media_ogg.decode(broken)


def test_rows(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "long " * 30_000]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media_ogg.to_media(df).collect()
    assert len(got) == 7
    for r, (d, t, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), rows, strict=True):
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) == (d, len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert media_ogg.decode(bytes(r.media))[0] == payload
    assert media_ogg.to_media(df.limit(0)).collect() == []


def test_whole_table(spark, sf):
    from larkspur.llm.queries import op3_media_ogg

    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_media_ogg(spark, sf).collect():
        data = docs[r.doc_id]
        assert r.payload_sha256 == hashlib.sha256(data + bytes(-len(data) % 64)).hexdigest()
