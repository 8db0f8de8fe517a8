"""Media columns: bytes stored as 8-bit samples in Ogg, checked, demultiplexed and read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import text_bytes

#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64
#: Samples a second; a granule position counts samples.
RATE = 8_000
#: Samples in a packet.
PACKET = 4_000
#: Logical streams that take turns, packet by packet.
SERIALS = (1, 2)
#: Flags of a page header.
CONTINUED, FIRST, LAST = 1, 2, 4
#: No packet ends on the page.
NO_GRANULE = -1
HEAD = struct.Struct("<4sBBqIIIB")
IDENT = struct.Struct("<8sIHHQ")
MAGIC = b"\x80raw8bit"

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes are not a well-formed Ogg file."""


def page_checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, most significant bit first, from 0 and without a final complement.

    zlib's CRC has the same polynomial with bits mirrored, so bytes and result are mirrored here.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(size: int) -> bytes:
    """Segment sizes of a packet: 255s, then one below 255."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def write_pages(serial: int, packets: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Pages of one logical stream with the place of the packet that each begins with.

    ``packets`` are (granule position at its end, data). The first packet has a page of its
    own; after that a page is full at 255 segments, and packets run on over page ends.
    """
    sequence, flags = 0, FIRST
    table, body, granule, place = bytearray(), [], NO_GRANULE, 0

    def page(last: bool) -> bytes:
        head = HEAD.pack(b"OggS", 0, flags | LAST * last, granule, serial, sequence, 0, len(table))
        whole = bytearray(head + bytes(table) + b"".join(body))
        whole[22:26] = page_checksum(bytes(whole)).to_bytes(4, "little")
        return bytes(whole)

    for k, (end, data) in enumerate(packets):
        values, at = lacing(len(data)), 0
        while values:
            take = values[: 255 - len(table)]
            size = sum(take)
            table += take
            body.append(data[at : at + size])
            at, values = at + size, values[len(take) :]
            if not values:
                granule = end
            last = k == len(packets) - 1 and not values
            if last or k == 0 or len(table) == 255:
                yield place, page(last)
                sequence, flags, place = sequence + 1, CONTINUED if values else 0, k + (not values)
                table, body, granule = bytearray(), [], NO_GRANULE


def encode(payload: bytes) -> bytes:
    """An Ogg file with ``payload`` as unsigned 8-bit mono samples, dealt to the logical streams in turn."""
    cuts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    pages = []
    for turn, serial in enumerate(SERIALS):
        packets, at = [(0, IDENT.pack(MAGIC, RATE, 1, len(SERIALS), len(payload)))], 0
        for k, data in enumerate(cuts):
            at += len(data)
            if k % len(SERIALS) == turn:
                packets.append((at, data))
        pages += [(n > 0, place, turn, n, page) for n, (place, page) in enumerate(write_pages(serial, packets))]
    return b"".join(page for *_, page in sorted(pages))


@dataclass
class Stream:
    """What the reader holds of a logical stream; ``packets`` are (granule position or -1, data)."""

    packets: list[tuple[int, bytes]] = field(default_factory=list)
    part: list[bytes] = field(default_factory=list)
    sequence: int = 0
    ended: bool = False


def demultiplex(media: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of pages; every checksum, sequence number and flag is verified."""
    streams: dict[int, Stream] = {}
    at = pages = 0
    while at < len(media):
        if len(media) < at + HEAD.size:
            raise OggError("a page header is cut off")
        magic, version, flags, granule, serial, sequence, checksum, segments = HEAD.unpack_from(media, at)
        table = media[at + HEAD.size : at + HEAD.size + segments]
        end = at + HEAD.size + segments + sum(table)
        if magic != b"OggS" or version or len(table) < segments or end > len(media):
            raise OggError(f"no page at byte {at}")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != checksum:
            raise OggError(f"the page at byte {at} fails its checksum")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if s.ended or sequence != s.sequence or bool(flags & CONTINUED) != bool(s.part):
            raise OggError(f"stream {serial} has a page missing or too many")
        body, done = at + HEAD.size + segments, []
        run = 0
        for value in table:
            run += value
            if value < 255:
                done.append(b"".join([*s.part, media[body : body + run]]))
                s.part, body, run = [], body + run, 0
        if run:
            s.part.append(media[body : body + run])
        s.packets += [(NO_GRANULE, x) for x in done[:-1]] + [(granule, x) for x in done[-1:]]
        s.sequence, s.ended, at, pages = sequence + 1, bool(flags & LAST), end, pages + 1
    if any(not s.ended or s.part for s in streams.values()):
        raise OggError("a stream doesn't end")
    return streams, pages


def decode(media: bytes) -> tuple[bytes, dict[str, int]]:
    """The payload of ``encode`` and features of the file.

    A page tells the granule position of the last packet that ends on it; those of earlier
    packets follow from the sizes, as each turn adds the samples of every stream's packet.
    """
    streams, pages = demultiplex(media)
    timed: list[tuple[int, bytes]] = []
    rate = total = 0
    for serial, s in sorted(streams.items()):
        magic, rate, _, turns, total = IDENT.unpack(s.packets[0][1])
        if magic != MAGIC or turns != len(streams):
            raise OggError(f"stream {serial} has no known head")
        end = 0
        for granule, data in reversed(s.packets[1:]):
            end = granule if granule != NO_GRANULE else end
            timed.append((end, data))
            end -= len(data) + (turns - 1) * PACKET
    timed.sort()
    at = 0
    for end, data in timed:
        at += len(data)
        if end != at:
            raise OggError(f"a packet ends at sample {end} and not at {at}")
    payload = b"".join(data for _, data in timed)
    if len(payload) != total:
        raise OggError("samples are missing")
    return payload, {"streams": len(streams), "pages": pages, "packets": len(timed), "rate": rate, "ms": at * 1000 // max(1, rate)}


def padded(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of UNIT."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Each text as an Ogg file, with what reading that file gives.

    Returns id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature and, with ``keep_media``, the file itself as ``media``. Payload
    columns come from the bytes read back. One row out for each row in, in one pass without
    a shuffle: null text counts as empty (64 zero bytes), a null id stays null, repeated rows
    give repeated results, other input columns are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{id_col}` {kinds[id_col]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary" * keep_media

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = []
                for data in text_bytes(part.column(1)):
                    media = encode(padded(data))
                    payload, found = decode(media)
                    mean = sum(payload) // len(payload)
                    feature = ";".join(f"{k}={v}" for k, v in found.items()) + f";mean={mean};peak={max(payload)}"
                    rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, media))
                columns = list(zip(*rows, strict=True))[: 7 + keep_media]
                kinds_out = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds_out, strict=False))], [id_col, *names[: len(columns)]])

    return df.select(id_col, text_col).mapInArrow(convert, schema)
