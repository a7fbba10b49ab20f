"""Media columns: signature sniffing with an Aho-Corasick automaton and format validators."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, table

#: Payloads are padded with bytes of PAD to a positive multiple of UNIT (given by the contract).
UNIT, PAD, TAIL = 576, b"\xff", 32
#: Width of stored images; it divides UNIT, so rows are full.
WIDTH = 24

# Magic bytes of the formats, the offset at which they stand in a file, and the media type.
SIGNATURES = (
    (b"RIFF", "audio/wav"),
    (b".snd", "audio/basic"),
    (b"BM", "image/bmp"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
)
STORED_AS = ("audio/wav", "audio/basic", "image/bmp", "image/png")


def wav_length(b: bytes, at: int) -> int:
    """Length of the RIFF/WAVE file at ``at`` if its chunks fit and it has a format and a data chunk, else 0."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return 0
    seen, p = set(), at + 12
    while p + 8 <= end:
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        if p + 8 + n > end:
            return 0
        seen.add(b[p : p + 4])
        p += 8 + n + n % 2
    return end - at if {b"fmt ", b"data"} <= seen else 0


def au_length(b: bytes, at: int) -> int:
    """Length of the AU file at ``at`` if its header is sound and its data fit, else 0."""
    if len(b) < at + 24:
        return 0
    offset, size, encoding, rate, channels = struct.unpack_from(">5I", b, at + 4)
    ok = offset >= 24 and 1 <= encoding <= 27 and rate > 0 and 1 <= channels <= 256 and at + offset + size <= len(b)
    return offset + size if ok else 0


def bmp_length(b: bytes, at: int) -> int:
    """Length of the BMP file at ``at`` if its header is sound and its pixels fit, else 0."""
    if len(b) < at + 30:
        return 0
    size, reserved, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if reserved or header not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        return 0
    need = (width * bits + 31) // 32 * 4 * abs(height)
    return size if 14 + header <= offset and offset + need <= size and at + size <= len(b) else 0


def png_length(b: bytes, at: int) -> int:
    """Length of the PNG file at ``at`` if its chunks fit, their checksums hold and it ends, else 0."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def gif_length(b: bytes, at: int) -> int:
    """Length of the GIF file at ``at`` if its blocks fit and it ends, else 0."""

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    if len(b) < at + 14:
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def jpeg_length(b: bytes, at: int) -> int:
    """Length of the JPEG file at ``at`` if its segments fit, it has a frame and it ends, else 0."""
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2:
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", p)
            return end + 2 - at if frame and end >= 0 else 0
    return 0


VALIDATORS = {"audio/wav": wav_length, "audio/basic": au_length, "image/bmp": bmp_length, "image/png": png_length, "image/gif": gif_length, "image/jpeg": jpeg_length}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, kind in SIGNATURES:
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def sniff(data: bytes, machine) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the media found: signatures whose structure holds.

    What begins at byte 0 comes first; what lies further in, inside it or behind it, follows, the first of those that overlap.
    """
    found, end = [], 1
    for last, (n, kind) in machine.iter(data.decode("latin-1")):
        at = last - n + 1
        if at and at < end:
            continue
        length = VALIDATORS[kind](data, at)
        if length:
            found.append((kind, at, length))
            end = at + length if at else end
    return found


def encode(payload: bytes, kind: str) -> bytes:
    """The payload as 8-bit samples of a sound (8000 Hz, mono) or of a grey image of ``WIDTH`` columns."""
    n = len(payload)
    if kind == "audio/wav":
        pad = b"\0" * (n % 2)
        return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload + pad
    if kind == "audio/basic":
        return b".snd" + struct.pack(">5I", 24, n, 2, 8000, 1) + payload
    if kind == "image/bmp":
        greys = bytes(x for k in range(256) for x in (k, k, k, 0))
        start = 54 + len(greys)
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", start + n, 0, start, 40, WIDTH, -(n // WIDTH), 1, 8, 0, n, 2835, 2835, 256, 0) + greys + payload
    rows = np.zeros((n // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    chunk = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, n // WIDTH, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode(data: bytes, kind: str) -> bytes:
    """The samples of what ``encode`` stored, read by the container's own fields."""
    if kind == "audio/wav":
        p = 12
        while data[p : p + 4] != b"data":
            n = int.from_bytes(data[p + 4 : p + 8], "little")
            p += 8 + n + n % 2
        return data[p + 8 : p + 8 + int.from_bytes(data[p + 4 : p + 8], "little")]
    if kind == "audio/basic":
        offset, size = struct.unpack_from(">2I", data, 4)
        return data[offset : offset + size]
    if kind == "image/bmp":
        offset, _, width, height = struct.unpack_from("<IIii", data, 10)
        return data[offset : offset + width * -height]
    p, packed, width = 8, [], 0
    while p < len(data):
        n, name = int.from_bytes(data[p : p + 4], "big"), data[p + 4 : p + 8]
        width = int.from_bytes(data[p + 8 : p + 12], "big") if name == b"IHDR" else width
        packed += [data[p + 8 : p + 8 + n]] if name == b"IDAT" else []
        p += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def describe(samples: bytes) -> str:
    """Features of 8-bit samples: mean, root mean square about the middle, crossings of it, and the entropy of the values."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256) - 128
    share = counts[counts > 0] / len(x)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"mean={(counts @ values) / len(x):.4f};rms={np.sqrt((counts @ values**2) / len(x)):.4f};crossings={crossings};entropy={-(share * np.log2(share)).sum():.4f}"


FOUND = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))


def sniff_column(df: DataFrame, data_col: str, declared_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``media_type`` (of what begins at byte 0 of a binary column, else the declared type, else null), ``corrected``
    (it differs from the declared one) and ``embedded`` (array of type, offset, length of media found further in).

    A null value has the declared type, no correction and no embedded media; unknown or broken content keeps the
    declared type.  Input columns with these names are replaced.
    """

    def make():
        machine = automaton()

        def run(data, *declared):
            types, corrected, embedded = [], [], []
            for k, b in enumerate(data):
                said = declared[0][k].as_py() if declared else None
                found = sniff(b.as_py(), machine) if b.is_valid else []
                kind = found[0][0] if found and found[0][1] == 0 else said
                types.append(kind)
                corrected.append(kind != said)
                embedded.append([{"type": t, "offset": o, "length": n} for t, o, n in found if o])
            return types, corrected, pa.array(embedded, pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))

        return run

    fields = [T.StructField("media_type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("embedded", FOUND)]
    return annotate(df, [data_col, *([declared_col] if declared_col else [])], make, fields, keep)


def carve(df: DataFrame, data_col: str) -> DataFrame:
    """One row per embedded medium of a sniffed table: the input columns but the data, ``type``, and its bytes as ``carved``.

    Rows whose list is null or empty give none.  Input columns named ``type`` or ``carved`` are replaced.
    """
    rows = df.withColumn("_e", F.explode("embedded"))
    piece = F.substring(F.col(data_col), (F.col("_e.offset") + 1).cast("int"), F.col("_e.length").cast("int"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c not in (data_col, "embedded", "type", "carved")], F.col("_e.type").alias("type"), piece.alias("carved"))


DIGEST = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("media_type", T.StringType()),
    T.StructField("n_embedded", T.LongType()),
]


def store_as_media(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``media`` (binary): the UTF-8 text, padded, as a sound or image file; the text's hash picks the format.

    Null texts count as empty: one unit of padding.
    """

    def make():
        return lambda texts: (pa.array([stored_form(t.as_py())[1] for t in texts], pa.binary()),)

    return annotate(docs, [text_col], make, [T.StructField("media", T.BinaryType())], keep)


def stored_form(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + PAD * (-len(raw) % UNIT if raw else UNIT)
    return len(raw), encode(payload, STORED_AS[zlib.crc32(raw) % len(STORED_AS)])


def media_digest(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Store each text as media, sniff the stored bytes for their type, read the samples back and describe them.

    Nothing is known of the stored form but its bytes, declared as ``audio/wav`` throughout; the sniffed type decides how
    they are read.  Equal texts have equal results; null counts as empty.  Input columns with the names of the new ones
    are replaced.
    """

    def make():
        machine = automaton()

        def run(texts):
            rows = []
            for text in texts:
                n, media = stored_form(text.as_py())
                found = sniff(media, machine)
                kind = found[0][0]
                samples = decode(media, kind)
                feature = f"{kind};{describe(samples)};embedded={len(found) - 1}"
                rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind, len(found) - 1))
            return [list(c) for c in zip(*rows, strict=True)]

        return run

    return annotate(docs, [text_col], make, DIGEST, keep)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as media and read back: sizes, hashes and features; rows as in ``media_digest``."""
    return media_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


ORACLE: dict[str, str] = {}
