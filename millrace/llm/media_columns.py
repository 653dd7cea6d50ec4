"""Media columns: bytes kept losslessly in the coefficients of progressive JPEG images, and images as RGB tensors.

A payload is a whole number of 64-byte blocks; each becomes one 8 x 8 block of coefficients, all quantised by 1. Of the
blocks of an image the first two thirds are luma, the rest blue and red chroma, which is sampled 2 x 2. A byte's rank
(frequent letters first) is the DC coefficient, or 128 more than the rank's last seven bits is an AC coefficient's size
and the rank's first bit its sign. So every AC coefficient is there from the first scan on. Luma comes in two bands
of the spectrum with signs and one bit, and six refining scans over both; chroma in one band each with signs and
three bits, and four refining scans; the DC coefficients of all in eight interleaved refining scans. An image is 16
pixels wide and holds up to MOST blocks; longer payloads are several images, one after another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import materialize, pick
from millrace.llm.progressive_jpeg import Image, decode_coefficients, to_rgb

MOST = 4096
_SLICE_BYTES = 8 << 20
_FREQUENT = " etanoirshdlucmgfpwbyv,.\nkjxqzETAONIRSHDLUCMGFPWBYVKJXQZ0123456789-'\"()!?:;%$&*#|/_\xc3\xa9\xa8\xa4\xbc\xb6\xad\xb3\xb1\xa7\xaa\x9f".encode("latin-1")
_ORDER = bytes(dict.fromkeys(_FREQUENT)) + bytes(b for b in range(256) if b not in _FREQUENT)
_RANKS = bytes(_ORDER.index(b) for b in range(256))


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _huffman(kind: int, slot: int, lengths: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot]) + bytes(len(lengths.get(n, ())) for n in range(1, 17)) + bytes(s for n in sorted(lengths) for s in lengths[n]))


#: DC: difference 0 is the code 0. AC, slots 0 and 2: one coefficient of size 2 or 4 is the code 0. AC, slot 1: runs of
#: blocks without new coefficients, 4 bits for each size of run.
_TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _huffman(0, 0, {1: [0]}) + _huffman(1, 0, {1: [2]}) + _huffman(1, 2, {1: [4]}) + _huffman(1, 1, {4: [n << 4 for n in range(13)]})
_BAND = 16  # the first coefficient of luma's second band


def _scan(components: str | int, tables: int, ss: int, se: int, ah: int, al: int, bits: np.ndarray) -> bytes:
    return _packed_scan(components, tables, ss, se, ah, al, _packed(bits)[0])


def _packed(bits: np.ndarray) -> list[bytes]:
    """The bytes of each row of bits (or of a single one), filled up with 1."""
    bits = np.atleast_2d(bits)
    rows = np.packbits(bits, axis=1)
    if bits.shape[1] % 8:
        rows[:, -1] |= (1 << -bits.shape[1] % 8) - 1
    return [row.tobytes() for row in rows]


def _packed_scan(components: str | int, tables: int, ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    named = (components,) if isinstance(components, int) else map(int, components)
    head = b"".join(bytes([c, tables]) for c in named)
    return _segment(0xDA, bytes([len(head) // 2]) + head + bytes([ss, se, ah << 4 | al])) + data.replace(b"\xff", b"\xff\0")


def _first_bits(planes: np.ndarray, start: int, end: int, size: int) -> np.ndarray:
    """Code and bits of the AC coefficients from start to end, the first `size` bits of each. planes: n x 64 x 8, bit 0 the
    sign; the highest bit of the magnitude is 1 and stands for it where the value is above 0. A value below 0 is sent
    with all bits turned."""
    own = planes[:, start:end]
    out = np.zeros((*own.shape[:2], size + 1), np.uint8)
    below = own[:, :, 0]
    out[:, :, 1] = 1 - below
    for k in range(1, size):
        out[:, :, k + 1] = own[:, :, k] ^ below
    return out.reshape(-1)


def _refinements(component: int, planes: np.ndarray, first: int) -> list[bytes]:
    """Scans of the bits of all AC coefficients from `first` on; one run without new coefficients spans all blocks."""
    n = len(planes)
    size = n.bit_length() - 1
    run = np.array([int(b) for b in f"{size:04b}" + (f"{n - (1 << size):0{size}b}" if size else "")], np.uint8)
    bits = np.empty((8 - first, len(run) + n * 63), np.uint8)
    bits[:, : len(run)] = run
    bits[:, len(run) :] = planes[:, 1:, first:].transpose(2, 0, 1).reshape(8 - first, -1)
    return [_packed_scan(component, 1, 1, 63, 8 - k, 7 - k, data) for k, data in enumerate(_packed(bits), first)]


def _shape(named: int) -> tuple[int, int]:
    """Rows of two luma blocks, and of chroma blocks, that hold so many blocks in all."""
    rows = max(1, named // 3 - 2)
    while 2 * rows + 2 * -(-rows // 2) < named:
        rows += 1
    return rows, -(-rows // 2)


def _encode_image(blocks: np.ndarray) -> bytes:
    """blocks: n x 64 ranks."""
    named = len(blocks)
    rows, units = _shape(named)
    every = np.zeros((6 * units, 64), np.uint8)  # luma with what rounds it up to units of 2 x 2, then each chroma
    luma = min(named, 2 * rows)
    every[:luma] = blocks[:luma]
    every[4 * units : 4 * units + named - luma] = blocks[luma:]
    planes = np.unpackbits(every[:, :, None], axis=2)  # n x 64 x 8, first bit first
    y, cb, cr = planes[: 2 * rows], planes[4 * units : 5 * units], planes[5 * units :]
    out = [b"\xff\xd8", _segment(0xFE, b"blocks %d" % named), _TABLES]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 8 * rows, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_scan("123", 0, 0, 0, 0, 8, np.zeros(6 * units, np.uint8)))
    out += [_scan(1, 0, a, z, 0, 6, _first_bits(y, a, z + 1, 2)) for a, z in ((1, _BAND - 1), (_BAND, 63))]
    out += [_scan(c, 2, 1, 63, 0, 4, _first_bits(own, 1, 64, 4)) for c, own in ((2, cb), (3, cr))]
    out += _refinements(1, y, 2) + _refinements(2, cb, 4) + _refinements(3, cr, 4)
    dc = planes[:, 0]
    dc = np.concatenate([dc[: 4 * units].reshape(units, 4, 8), dc[4 * units :].reshape(2, units, 8).transpose(1, 0, 2)], axis=1).reshape(-1, 8)
    out += [_packed_scan("123", 0, 0, 0, 8 - k, 7 - k, data) for k, data in enumerate(_packed(dc.T))]
    return b"".join([*out, b"\xff\xd9"])


def encode_payload(payload: bytes) -> bytes:
    """payload: a positive multiple of 64 bytes."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    blocks = np.frombuffer(payload.translate(_RANKS), np.uint8).reshape(-1, 64)
    return b"".join([_encode_image(blocks[k : k + MOST]) for k in range(0, len(blocks), MOST)])


def images(media: bytes) -> Iterator[Image]:
    at = 0
    while at < len(media):
        image, at = decode_coefficients(media, at)
        yield image


def payload_of(image: Image) -> bytes:
    n = int(image.comments[0].split()[1])
    values = np.concatenate([c.coefficients[: c.high, : c.wide].reshape(-1, 64) for c in image.components])[:n]
    ranks = np.abs(values) - 128 + 128 * (values < 0)
    ranks[:, 0] = values[:, 0]
    return ranks.astype(np.uint8).tobytes().translate(_ORDER)


def padded(data: bytes) -> bytes:
    return data + b"\0" * (64 - len(data) % 64 if len(data) % 64 or not data else 0)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, sizes, media, held = 0, [], [], 0
        for k in range(batch.num_rows):
            data = (batch.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass")
            sizes.append(len(data))
            media.append(encode_payload(padded(data)))
            held += len(media[-1])
            if held >= _SLICE_BYTES or k + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sizes)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                start, sizes, media, held = k + 1, [], [], 0


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, zeros appended up to a positive multiple of 64, as JPEG.
    A null text is empty: 64 zeros."""
    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: bytes) -> tuple:
    """What is known of one media value from its bytes alone. The feature has width, heights, sums of red, green and
    blue, and a checksum of the RGB tensors."""
    hashed, size, tail, crc = hashlib.sha256(), 0, b"", 0
    sums, heights = np.zeros(3, np.int64), []
    for image in images(media):
        payload = payload_of(image)
        hashed.update(payload)
        size, tail = size + len(payload), payload[-64:]
        rgb = to_rgb(image)
        crc = zlib.crc32(rgb, crc)
        sums += rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        heights.append(image.height)
    feature = f"16x{sum(heights)} rgb={','.join(map(str, sums))} crc={crc:08x}"
    return size, hashed.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


def _describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [describe(m.as_py()) for m in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[c.split()[0] for c in _READ.split(", ")])


def store_and_describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media in a table, read the table back and describe what was read, a row for each row of
    docs. Null and empty texts are 64 zeros; a null id stays. An empty table gives an empty result."""
    stored = materialize(text_to_media(docs, id_col, text_col), "media")
    return stored.mapInArrow(_describe_batches, _READ)


def _tensor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            rows = []
            media = batch.column(1)[k].as_py()
            for place, image in enumerate(images(media or b"")):
                rgb = to_rgb(image)
                rows.append((batch.column(0)[k].as_py(), place, rgb.shape[0], rgb.shape[1], rgb.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["id", "place", "height", "width", "rgb"])


def rgb_tensors(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, place, height, width, rgb): full-resolution tensors, rows of pixels, of all images in a binary column.
    Null and empty values give no row; a value that is no image of the kinds read fails the query."""
    return pick(media, id=id_col, media=media_col).select(F.col("id").cast("long"), F.col("media").cast("binary")).mapInArrow(_tensor_batches, "id long, place int, height int, width int, rgb binary")
