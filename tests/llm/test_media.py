import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from paperloom.llm import media


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"


def jpeg():
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xda" + struct.pack(">H", 8) + b"\0" * 6 + b"\x12\x34" + b"\xff\xd9"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


WAV = b"RIFF" + struct.pack("<I", 4 + 24 + 8 + 4) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 4) + b"abcd"
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"
GOOD = {"image/png": png(), "image/gif": gif(), "image/bmp": bmp(), "image/jpeg": jpeg(), "application/zip": zipped(), "application/gzip": gzip.compress(b"hello" * 50), "audio/wav": WAV, "application/pdf": PDF, "audio/basic": b".snd" + struct.pack(">IIIII", 24, 3, 1, 8000, 1) + b"xyz"}


def test_every_format_is_confirmed_alone_and_carved_inside():
    machine = media.automaton()
    for kind, blob in GOOD.items():
        alone = media.sniff_bytes(blob, machine)
        assert (alone[0][0], alone[0][1], alone[0][2]) == (kind, 0, len(blob)), kind
        inside = media.sniff_bytes(b"some prose " + blob + b" and more", machine)
        assert [(x[0], x[1], x[2]) for x in inside] == [(kind, 11, len(blob))], kind


def test_cut_or_false_signatures_are_no_media():
    machine = media.automaton()
    for kind, blob in GOOD.items():
        assert not media.sniff_bytes(b"x" + blob[:-1], machine), kind
    for text in (b"BM is short", b"RIFF off WAVE", b"GIF89a", b"%PDF- soon", b"PK\x03\x04", b"\x1f\x8b\x08 not gzip", b"\xff\xd8\xff", b".snd", b"", b"BM" * 100):
        assert not media.sniff_bytes(text, machine)


def test_broken_bytes_never_raise():
    machine = media.automaton()
    for blob in GOOD.values():
        for i in range(len(blob)):
            media.sniff_bytes(blob[:i] + b"\xff" + blob[i + 1 :], machine)


def test_sniff_corrects_types_and_carves(spark):
    rows = [(1, "image/jpeg", bytearray(png())), (2, "image/gif", bytearray(gif())), (3, "text/plain", bytearray(b"see " + png() + b" and " + gif())), (4, None, None)]
    found = media.sniff(spark.createDataFrame(rows, "id long, declared string, media binary"))
    got = {r.id: r for r in found.collect()}
    assert (got[1].media_type, "corrected=1" in got[1].feature) == ("image/png", True)
    assert (got[2].media_type, "corrected=0" in got[2].feature) == ("image/gif", True)
    assert (got[3].media_type, [c.media_type for c in got[3].carved]) == ("application/octet-stream", ["image/png", "image/gif"])
    assert (got[4].media_type, got[4].media_length) == ("application/octet-stream", 0)
    parts = sorted((r.id, r.n, bytes(r.media)) for r in media.carve(found).collect())
    assert parts == [(3, 0, png()), (3, 1, gif())]


def check(rows, texts):
    def key(x):
        return tuple((v is None, v) for v in x)

    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=key)
    want = []
    for doc_id, text in texts:
        raw = (text or "").encode()
        full = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        want.append((doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert got == sorted(want, key=key)
    stored = {}
    for r in rows:
        assert stored.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_hard_rows(hard, clashing, empty):
    texts = [(r.doc_id, r.text) for r in hard.collect()]
    for docs in (hard, clashing):
        check(media.digests(media.sniff(media.store_texts(docs))).collect(), texts)
    assert media.digests(media.sniff(media.store_texts(empty))).count() == 0


def test_whole_table(spark, small):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(media.op5_media_columns(spark, small).collect(), texts)
