"""Media columns: signature sniffing.

An Aho-Corasick automaton finds magic bytes anywhere in a stored value; a validator for each format
confirms structure and lengths, so a magic string inside prose is no hit. The format at offset 0
corrects the declared type; confirmed media further inside are carved.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Magic bytes, where in the file they stand, media type.
MAGIC = (
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b".snd", 0, "audio/basic"),
)
RIFF_FORMS = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}

PAYLOAD_UNIT = 192
WAV_RATE = 8000
SCHEMA = "id long, media_type string, media_length long, data_offset long, data_length long, samples long, carved array<struct<offset: long, length: long, media_type: string>>, feature string"


def u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little")


def riff(b: bytes, at: int) -> tuple[str, int, int, int, int] | None:
    """(type, length, data offset, data length, samples): chunks must fill the declared size exactly.

    samples: what a fact chunk declares, else the data's length.
    """
    kind, end = RIFF_FORMS.get(b[at + 8 : at + 12]), at + 8 + u32(b, at + 4)
    if not kind or end > len(b) or end < at + 12:
        return None
    p, data, names, samples = at + 12, (0, 0), set(), None
    while p + 8 <= end:
        name, n = b[p : p + 4], u32(b, p + 4)
        names.add(name)
        if name == b"data":
            data = (p + 8, n)
        if name == b"fact" and n >= 4:
            samples = u32(b, p + 8)
        if p + 8 + n > end:
            return None
        p += 8 + n + (n & 1)
    if p < end or kind == "audio/wav" and not {b"fmt ", b"data"} <= names:
        return None
    return kind, end - at, *data, data[1] if samples is None else samples


def png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, name = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first != (name == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        p, first = p + 12 + n, False
        if name == b"IEND":
            return p - at
    return 0


def gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p = blocks(p + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
        else:
            return 0
    return 0


def jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if mark == 0xDA:
            end = b.find(b"\xff\xd9", p + 2 + n)
            return end + 2 - at if end >= 0 else 0
        if n < 2 or not 0xC0 <= mark <= 0xFE:
            return 0
        p += 2 + n
    return 0


def bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    if zero or at + size > len(b) or header not in (12, 40, 52, 56, 108, 124) or not 14 + header <= offset < size or int.from_bytes(b[at + 26 : at + 28], "little") not in (0, 1):
        return 0
    return size


def pdf(b: bytes, at: int) -> int:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return 0
    start = b.find(b"startxref", at)
    end = b.find(b"%%EOF", start) if start >= 0 else -1
    return end + 5 - at if end >= 0 else 0


def zipped(b: bytes, at: int) -> int:
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
    if at + offset + size != end or b[at + offset : at + offset + 4] != b"PK\x01\x02":
        return 0
    return min(len(b), end + 22 + comment) - at


def gzipped(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + 65536], 1 << 20)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - len(d.unused_data) - at if d.eof else 0


def au(b: bytes, at: int) -> int:
    if at + 24 > len(b):
        return 0
    offset, size, encoding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    return offset + size if offset >= 24 and 1 <= encoding <= 27 and rate and channels and at + offset + size <= len(b) else 0


VALIDATORS = {"image/png": png, "image/gif": gif, "image/jpeg": jpeg, "image/bmp": bmp, "application/pdf": pdf, "application/zip": zipped, "application/gzip": gzipped, "audio/basic": au}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, offset, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), offset, kind))
    found.make_automaton()
    return found


def sniff_bytes(b: bytes, machine) -> list[tuple[str, int, int, int, int, int]]:
    """(type, start, length, data offset, data length, samples) of confirmed media by place.

    What lies inside an accepted medium that doesn't start at 0 is part of it and isn't listed again.
    """
    found: list[tuple[str, int, int, int, int, int]] = []
    busy = 0
    for last, (n, offset, kind) in machine.iter(b.decode("latin-1")):
        at = last + 1 - n - offset
        if at < busy:
            continue
        if kind == "riff":
            hit = riff(b, at)
        else:
            length = VALIDATORS[kind](b, at)
            hit = (kind, length, at, length, length) if length > 0 else None
        if hit:
            found.append((hit[0], at, *hit[1:]))
            if at:
                busy = at + hit[1]
    return found


def sniffer():
    machine = automaton()

    def judge(batch) -> dict:
        rows = []
        for declared, blob in zip(batch.column("declared").to_pylist(), batch.column("media").to_pylist(), strict=True):
            b = blob if blob is not None else b""
            hits = sniff_bytes(b, machine)
            if hits and not hits[0][1]:
                (kind, _, length, offset, size, samples), inner = hits[0], hits[1:]
            else:  # no known format: plain bytes
                kind, length, offset, size, samples, inner = "application/octet-stream", len(b), 0, len(b), len(b), hits
            data = np.frombuffer(b, np.uint8, size, offset)
            level = data.astype(np.float32) - 128
            rms = float(np.sqrt(np.mean(level * level, dtype=np.float64))) if size else 0.0
            crossings = int(np.count_nonzero((data[1:] >= 128) != (data[:-1] >= 128))) if size else 0
            feature = f"type={kind};corrected={int(kind != declared)};bytes={size};mean={float(data.mean()) if size else 0:.4f};rms={rms:.4f};crossings={crossings};carved={','.join(x[0] for x in inner)}"
            carved = [{"offset": x[1], "length": x[2], "media_type": x[0]} for x in inner]
            rows.append((kind, length, offset, size, samples, carved, feature))
        return dict(zip(("media_type", "media_length", "data_offset", "data_length", "samples", "carved", "feature"), zip(*rows, strict=True), strict=True))

    return judge


def sniff(media: DataFrame) -> DataFrame:
    """Judge every row of media (id, declared type, media binary).

    Adds media_type (confirmed at offset 0, else application/octet-stream), media_length,
    data_offset and data_length (the samples of a RIFF file, else the whole), carved (confirmed media
    inside, by offset), and a feature string; the bytes go along. Null media count as empty. Rows are
    independent: no shuffle, and equal bytes give equal values. An empty table gives an empty one.
    """
    given = common.pick(media, id="long", declared="string", media="binary")
    return common.map_rows(given, f"{SCHEMA}, media binary", sniffer, rows=256)


def carve(sniffed: DataFrame) -> DataFrame:
    """One row per carved medium: id, its number, offset, media type, and its bytes."""
    rows = sniffed.select("id", "media", F.posexplode("carved").alias("n", "part"))
    return rows.select("id", "n", "part.offset", "part.media_type", F.expr("substring(media, cast(part.offset as int) + 1, cast(part.length as int))").alias("media"))


def le32(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def wav(payload: Column, samples: Column) -> Column:
    """A RIFF/WAVE file with one channel of unsigned 8-bit samples, one for each byte; its fact chunk holds `samples`."""
    n = F.octet_length(payload).cast("long")
    head = F.unhex(F.lit((b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, WAV_RATE, WAV_RATE, 1, 8) + b"fact" + struct.pack("<I", 4)).hex()))
    return F.concat(F.unhex(F.lit(b"RIFF".hex())), le32(n + 48), head, le32(samples), F.unhex(F.lit(b"data".hex())), le32(n), payload)


def store_texts(docs: DataFrame) -> DataFrame:
    """id, declared type and media of docs (doc_id, text): the text as UTF-8, padded by spaces to a
    positive multiple of 192 bytes, as samples of a WAV file whose fact chunk keeps the unpadded length.
    Null text counts as empty."""
    text = common.pick(docs, doc_id="long", text="string").select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    n = F.octet_length("bytes")
    full = F.greatest(F.ceil(n / PAYLOAD_UNIT), F.lit(1)) * PAYLOAD_UNIT
    padding = F.encode(F.repeat(F.lit(" "), (full - n).cast("int")), "UTF-8")
    return text.select("id", F.lit("text/plain").alias("declared"), wav(F.concat("bytes", padding), n).alias("media"))


def digests(sniffed: DataFrame) -> DataFrame:
    """Lengths and hashes of the samples that sniff() located in the stored bytes."""
    payload = F.expr("substring(media, cast(data_offset as int) + 1, cast(data_length as int))")
    read = sniffed.select("id", "samples", "feature", "media", payload.alias("payload"))
    return read.select(
        F.col("id").alias("doc_id"),
        F.col("samples").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(sniff(store_texts(common.table(spark, sf_dir, "documents"))))
