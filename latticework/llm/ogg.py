"""Media columns in the Ogg container.

``write_ogg`` puts 8-bit samples into two logical streams that take turns in
packets; ``read_ogg`` reads such bytes back: it verifies every page's checksum,
reassembles packets from the lacing values (also over page boundaries), separates
the logical streams by serial number, and derives each packet's time from the
granule positions of the pages. Both work on binary columns, in Arrow batches.

Each stream begins with a header packet of 20 bytes: ``PCM8``, samples a second,
samples in a packet, the stream's turn and the number of streams, as unsigned
32-bit numbers, low byte first. A granule position is the number of samples, of
all streams, up to the end of the last packet that ends on the page.

Defined results: a null media value has null in every field; media without
samples has an empty payload; damaged media (wrong checksum, a missing page, a
packet that goes on without having begun) raises ``ValueError``. Equal payloads
make equal media, so repeated rows repeat; an empty table gives no rows. Very long
payloads are handled page by page in linear time; their media is one value, as
long as the payload and 2 % more.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

RATE, PACKET, STREAMS, SEGMENTS = 8000, 1024, 2, 255
#: Payloads are filled up to a multiple of this many bytes.
UNIT = 192
_PAGE = struct.Struct("<4sBBqIIIB")
_HEAD = struct.Struct("<4sIIII")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Every byte with its bits in the other order.
_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with the polynomial 0x04C11DB7, high bit first, from 0 and not inverted.

    zlib has the same polynomial low bit first, from all ones and inverted: so
    bits are turned round before and after, and ones are taken away.
    """
    low_first = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low_first.to_bytes(4, "little").translate(_TURNED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_checksum(head + lacing + body)
    return _PAGE.pack(b"OggS", 0, flags, granule, serial, number, crc, len(lacing)) + lacing + body


def write_ogg(payload: bytes, packet: int = PACKET, streams: int = STREAMS, segments: int = SEGMENTS) -> bytes:
    """The payload as an Ogg file; ``segments`` is the most lacing values on a page."""
    base = zlib.crc32(payload)
    serials = [(base + k) & 0xFFFFFFFF for k in range(streams)]
    pages = [_page(FIRST, 0, s, 0, bytes([_HEAD.size]), _HEAD.pack(b"PCM8", RATE, packet, k, streams)) for k, s in enumerate(serials)]
    later: list[tuple[int, int, bytes]] = []
    for k, serial in enumerate(serials):
        lacing, body, number, granule, goes_on = bytearray(), bytearray(), 1, -1, 0
        starts = range(k * packet, len(payload), packet * streams)
        for at in starts:
            data = payload[at : at + packet]
            end, done = at + len(data), 0
            left = len(data) // 255 + 1
            while left:
                if len(lacing) == segments:
                    later.append((granule if granule >= 0 else end, k, _page(goes_on, granule, serial, number, bytes(lacing), bytes(body))))
                    goes_on = CONTINUED if done else 0
                    lacing, body, number, granule = bytearray(), bytearray(), number + 1, -1
                n = min(255, len(data) - done)
                lacing.append(n)
                body += data[done : done + n]
                done += n
                left -= 1
            granule = end
        later.append((len(payload), k, _page(goes_on | LAST, granule if starts else 0, serial, number, bytes(lacing), bytes(body))))
    # Pages of the streams follow each other in time; the order within a stream stays.
    return b"".join(pages) + b"".join(p[2] for p in sorted(later, key=lambda p: p[:2]))


def read_pages(media: bytes):
    """(flags, granule, serial, number, lacing, body) of each page, its checksum verified."""
    at = 0
    while at < len(media):
        if len(media) - at < _PAGE.size:
            raise ValueError("cut page")
        magic, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + _PAGE.size : at + _PAGE.size + n]
        begin = at + _PAGE.size + n
        end = begin + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError("cut page")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum at byte {at}")
        yield flags, granule, serial, number, lacing, media[begin:end]
        at = end


def read_ogg(media: bytes) -> dict:
    """Payload, packets with their times, and what the pages tell of each stream."""
    streams: dict[int, dict] = {}
    pages = 0
    for flags, granule, serial, number, lacing, body in read_pages(media):
        pages += 1
        if flags & FIRST:
            if serial in streams:
                raise ValueError("a stream begins twice")
            streams[serial] = {"packets": [], "open": b"", "next": 0, "ended": False}
        s = streams.get(serial)
        if s is None or s["ended"] or number != s["next"]:
            raise ValueError("a page is missing")
        s["next"], s["ended"] = number + 1, bool(flags & LAST)
        if bool(flags & CONTINUED) != bool(s["open"]):
            raise ValueError("a packet's beginning is missing")
        at, ended = 0, []
        parts = [s["open"]] if s["open"] else []
        for n in lacing:
            parts.append(body[at : at + n])
            at += n
            if n < 255:
                ended.append(b"".join(parts))
                parts = []
        s["open"] = b"".join(parts)
        # The page's granule position belongs to its last packet; earlier ones are counted back from it.
        if ended and granule < 0:
            raise ValueError("a page with a packet's end has no granule position")
        s["packets"] += [(p, granule if k == len(ended) - 1 else None) for k, p in enumerate(ended)]
    timed, rate = [], RATE
    for serial, s in streams.items():
        if not s["ended"] or s["open"] or not s["packets"]:
            raise ValueError("a stream has no end")
        magic, rate, size, turn, count = _HEAD.unpack(s["packets"][0][0])
        if magic != b"PCM8":
            raise ValueError("an unknown stream")
        end = None
        for data, granule in reversed(s["packets"][1:]):
            # Between two packets of a stream lies one of each other stream.
            end = granule if granule is not None else end - tail - (count - 1) * size
            tail = len(data)
            timed.append((end - tail, turn, data))
    timed.sort(key=lambda p: p[:2])
    payload, at = [], 0
    for start, _, data in timed:
        if start != at:
            raise ValueError("samples are missing")
        payload.append(data)
        at += len(data)
    return {"payload": b"".join(payload), "pages": pages, "streams": len(streams), "times": [start * 1_000_000 // rate for start, _, _ in timed], "micros": at * 1_000_000 // rate}


def features(media: bytes) -> tuple[bytes, str]:
    """The payload read back, and what is computed from it and its packets."""
    got = read_ogg(media)
    wave = np.frombuffer(got["payload"], dtype=np.uint8).astype(np.int64) - 128
    mean = float(wave.mean()) if len(wave) else 0.0
    power = float((wave * wave).mean()) ** 0.5 if len(wave) else 0.0
    turns = int(np.count_nonzero(np.diff(np.signbit(wave)))) if len(wave) else 0
    times = hashlib.sha256(",".join(map(str, got["times"])).encode()).hexdigest()[:16]
    said = f"streams={got['streams']};pages={got['pages']};packets={len(got['times'])};micros={got['micros']};times={times};mean={mean:.4f};rms={power:.4f};crossings={turns}"
    return got["payload"], said


_BACK = [T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]


def _columns(fields: list[T.StructField], rows: list[tuple]) -> pa.Array:
    kinds = {T.BinaryType(): pa.binary(), T.StringType(): pa.string()}
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], type=kinds[f.dataType]) for k, f in enumerate(fields)], names=[f.name for f in fields])


@F.arrow_udf(T.BinaryType())
def _write(payload: pa.Array) -> pa.Array:
    return pa.array([None if x is None else write_ogg(x) for x in payload.to_pylist()], type=pa.binary())


@F.arrow_udf(T.StructType(_BACK))
def _read(media: pa.Array) -> pa.Array:
    return _columns(_BACK, [(None, None) if x is None else features(x) for x in media.to_pylist()])


_STORED = [T.StructField("media", T.BinaryType()), *_BACK]


@F.arrow_udf(T.StructType(_STORED))
def _stored(payload: pa.Array) -> pa.Array:
    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None
        media = write_ogg(data)
        return media, *features(media)

    return _columns(_STORED, [one(x.as_py()) for x in payload])


def to_ogg(payload: Column) -> Column:
    """A binary column as Ogg media."""
    small_batches(SparkSession.active())
    return _write(payload)


def from_ogg(media: Column) -> Column:
    """struct(payload, feature) of an Ogg column, read back and verified."""
    small_batches(SparkSession.active())
    return _read(media)


def stored_ogg(payload: Column) -> Column:
    """struct(media, payload, feature): a binary column written as Ogg media once, and what is read back from those bytes."""
    small_batches(SparkSession.active())
    return _stored(payload)


def padded(text: Column) -> Column:
    """A text's UTF-8 bytes, filled up with spaces to a positive multiple of UNIT; null counts as empty."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    whole = F.greatest(F.ceil(n / UNIT), F.lit(1)) * UNIT
    return F.concat(data, F.repeat(F.lit(" "), (whole - n).cast("int")).cast("binary"))


def op3_ogg(spark, sf_dir: str) -> DataFrame:
    """Every document stored as Ogg media, read back, and described."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    back = docs.select("doc_id", n.alias("n_bytes"), stored_ogg(padded(F.col("text"))).alias("kept"))
    size = F.octet_length("kept.payload")
    return back.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("kept.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("kept.payload"), size - 15, F.lit(16))).alias("tail_crc32"),
        F.octet_length("kept.media").cast("long").alias("media_bytes"),
        F.sha2("kept.media", 256).alias("media_sha256"),
        F.col("kept.feature").alias("feature"),
    )
