import gzip
import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import media_columns as M
from millrace.llm import progressive_jpeg as J
from millrace.llm import warc as W
from millrace.llm._shared import shared_path


class Writer:
    """A plain encoder, code by code, for any coefficients: it shares nothing with the decoder but the format."""

    def __init__(self, symbols):
        # 8-bit codes for up to 250 symbols
        self.symbols = sorted(symbols)
        self.code = {s: format(k, "08b") for k, s in enumerate(self.symbols)}

    def dht(self, kind, slot):
        return M._segment(0xC4, bytes([kind << 4 | slot]) + bytes([0] * 7 + [len(self.symbols)] + [0] * 8) + bytes(self.symbols))


ALL = Writer([r << 4 | s for r in range(16) for s in range(11)] + [11])


def size(v):
    return abs(int(v)).bit_length()


def extra(v):
    n, v = size(v), int(v)
    return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def point(v, al):
    return (abs(int(v)) >> al) * (1 if v > 0 else -1)


def pack(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def dc_first(blocks, al):
    out, last = "", {}
    for c, b in blocks:
        v = b[0] >> al
        d = v - last.get(c, 0)
        last[c] = v
        out += ALL.code[size(d)] + extra(d)
    return out


def ac_first(blocks, ss, se, al):
    out, eob = "", 0

    def flush():
        nonlocal out, eob
        if eob:
            n = eob.bit_length() - 1
            out += ALL.code[n << 4] + (format(eob - (1 << n), f"0{n}b") if n else "")
            eob = 0

    for b in blocks:
        run = 0
        for k in range(ss, se + 1):
            v = point(b[k], al)
            if not v:
                run += 1
                continue
            flush()
            while run > 15:
                out += ALL.code[0xF0]
                run -= 16
            out += ALL.code[run << 4 | size(v)] + extra(v)
            run = 0
        eob += bool(run)
    flush()
    return out


def ac_refine(blocks, ss, se, al):
    out, eob, held = "", 0, ""

    def flush():
        nonlocal out, eob, held
        if eob:
            n = eob.bit_length() - 1
            out += ALL.code[n << 4] + (format(eob - (1 << n), f"0{n}b") if n else "") + held
            eob, held = 0, ""

    for b in blocks:
        v = [abs(b[k]) >> al for k in range(64)]
        last = max([k for k in range(ss, se + 1) if v[k] == 1], default=-1)
        run, fix = 0, ""
        for k in range(ss, se + 1):
            if v[k] == 0:
                run += 1
                continue
            while run > 15 and k <= last:
                flush()
                out += ALL.code[0xF0] + fix
                run, fix = run - 16, ""
            if v[k] > 1:
                fix += str(v[k] & 1)
                continue
            flush()
            out += ALL.code[run << 4 | 1] + ("1" if b[k] > 0 else "0") + fix
            run, fix = 0, ""
        if run or fix:
            eob, held = eob + 1, held + fix
    flush()
    return out


def sos(components, ss, se, ah, al):
    return M._segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([ss, se, ah << 4 | al]))


def colour_image(width, height, seed, restart=0, sampling=(2, 2)):
    """Progressive 4:2:0 (or other) image of random coefficients: spectral selection, two refinements, interleaved DC."""
    r = random.Random(seed)
    h, v = sampling
    mw, mh = -(-width // (8 * h)), -(-height // (8 * v))
    shapes = {1: (mh * v, mw * h), 2: (mh, mw), 3: (mh, mw)}
    own = {1: (-(-height // 8), -(-width // 8)), 2: (-(-(-(-height // v)) // 8), -(-(-(-width // h)) // 8))}
    own[3] = own[2]
    coef = {c: np.zeros((*s, 64), int) for c, s in shapes.items()}
    for c, a in coef.items():
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                a[y, x, 0] = r.randint(-300, 300)
                if y < own[c][0] and x < own[c][1]:
                    for k in r.sample(range(1, 64), r.choice([0, 1, 5, 30])):
                        a[y, x, k] = r.choice([-1, 1]) * r.choice([1, 1, 2, 3, 9, 60])
    mcus = [(c, coef[c][my * (v if c == 1 else 1) + dy, mx * (h if c == 1 else 1) + dx]) for my in range(mh) for mx in range(mw) for c in (1, 2, 3) for dy in range(v if c == 1 else 1) for dx in range(h if c == 1 else 1)]
    blocks = {c: [coef[c][y, x] for y in range(own[c][0]) for x in range(own[c][1])] for c in coef}
    per = h * v + 2

    def cut(items, unit, f):
        if not restart:
            return pack(f(items))
        parts = [items[k : k + restart * unit] for k in range(0, len(items), restart * unit)]
        return b"".join(pack(f(p)) + (bytes([0xFF, 0xD0 + k % 8]) if k < len(parts) - 1 else b"") for k, p in enumerate(parts))

    out = b"\xff\xd8" + M._segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + M._segment(0xDB, b"\0" + bytes([3] * 64)) + ALL.dht(0, 0) + ALL.dht(1, 0)
    out += M._segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out += M._segment(0xDD, struct.pack(">H", restart)) if restart else b""
    out += sos([1, 2, 3], 0, 0, 0, 1) + cut(mcus, per, lambda x: dc_first(x, 1))
    for c in (1, 2, 3):
        out += sos([c], 1, 5, 0, 2) + cut(blocks[c], 1, lambda x: ac_first(x, 1, 5, 2))
        out += sos([c], 6, 63, 0, 2) + cut(blocks[c], 1, lambda x: ac_first(x, 6, 63, 2))
    for al in (1, 0):
        for c in (1, 2, 3):
            out += sos([c], 1, 63, al + 1, al) + cut(blocks[c], 1, lambda x: ac_refine(x, 1, 63, al))
    out += sos([1, 2, 3], 0, 0, 1, 0) + cut(mcus, per, lambda x: "".join(str(b[0] & 1) for _, b in x))
    return out + b"\xff\xd9", coef, own


def plain_rgb(coef, own, width, height, sampling):
    """Sample by sample from the definition."""
    basis = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    walk = []
    r = c = 0
    up = True
    for _ in range(64):  # the zigzag as it is drawn
        walk.append((r, c))
        if up:
            r, c, up = (r - 1, c + 1, True) if r > 0 and c < 7 else (r, c + 1, False) if c < 7 else (r + 1, c, False)
        else:
            r, c, up = (r + 1, c - 1, False) if c > 0 and r < 7 else (r + 1, c, True) if r < 7 else (r, c + 1, True)
    planes = {}
    for k, a in coef.items():
        plane = np.zeros((own[k][0] * 8, own[k][1] * 8))
        for y in range(own[k][0]):
            for x in range(own[k][1]):
                f = np.zeros((8, 8))
                for z, (i, j) in enumerate(walk):
                    f[i, j] = a[y, x, z] * 3
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.clip(np.round(basis.T @ f @ basis) + 128, 0, 255)
        planes[k] = plane
    out = np.zeros((height, width, 3))
    for y in range(height):
        for x in range(width):
            cb, cr = (planes[k][y // sampling[1], x // sampling[0]] - 128 for k in (2, 3))
            l = planes[1][y, x]  # noqa: E741
            out[y, x] = [l + 1.402 * cr, l - 0.344136 * cb - 0.714136 * cr, l + 1.772 * cb]
    return np.clip(np.round(out), 0, 255)


@pytest.mark.parametrize("width,height,restart,sampling", [(33, 21, 0, (2, 2)), (16, 16, 0, (2, 2)), (50, 9, 2, (2, 1)), (17, 40, 3, (1, 1))])
def test_colour_images(width, height, restart, sampling):
    data, coef, own = colour_image(width, height, width, restart, sampling)
    image, end = J.decode_coefficients(data)
    assert end == len(data)
    for c in image.components:
        y, x = own[c.name]
        assert np.array_equal(c.coefficients[:y, :x], coef[c.name][:y, :x])
    got = J.to_rgb(image).astype(int)
    assert got.shape == (height, width, 3)
    assert np.abs(got - plain_rgb(coef, own, width, height, sampling)).max() <= 1  # rounding of float32 sums


@pytest.mark.parametrize("blocks", [1, 2, 4, 5, 7, 23, 64])
def test_payload_images_use_chroma_and_both_bands(blocks):
    r = np.random.default_rng(blocks)
    payload = r.integers(0, 256, 64 * blocks, dtype=np.uint8).tobytes()
    media = M.encode_payload(payload)
    (image,) = M.images(media)
    assert M.payload_of(image) == payload
    assert media.count(b"\xff\xda") == 27 and (blocks < 3 or image.components[1].coefficients.any())
    coef = {c.name: c.coefficients / 3 for c in image.components}  # plain_rgb quantises by 3
    own = {c.name: (c.high, c.wide) for c in image.components}
    got = J.to_rgb(image).astype(int)
    assert np.abs(got - plain_rgb(coef, own, image.width, image.height, (2, 2))).max() <= 1


def test_broken_images_raise():
    data, _, _ = colour_image(16, 16, 1)
    for bad in (b"", b"GIF89a", data[:60], data[: len(data) // 2]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            J.decode_coefficients(bad)


TEXTS = [None, "", "a" * 63, "a" * 64, "a" * 65, "é漢😀" * 9, "\0\n", "x y" * 90_000, "dup", "dup"]


def test_payloads_come_back(spark):
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(TEXTS)] + [(None, "dup", "m")], "doc_id long, text string, media string")
    got = M.store_and_describe(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        p = M.padded((TEXTS[r["doc_id"]] if r["doc_id"] is not None else "dup" or "").encode() if (r["doc_id"] is None or TEXTS[r["doc_id"]] is not None) else b"")
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    alike = {(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (8, 9, None)}
    assert len(alike) == 1
    assert M.store_and_describe(df.limit(0)).count() == 0


def test_tensors(spark):
    data, *_ = colour_image(20, 12, 3)
    df = spark.createDataFrame([(1, bytearray(data + data)), (2, None)], "id long, media binary")
    rows = M.rgb_tensors(df, "id", "media").orderBy("place").collect()
    assert [(r["id"], r["place"], r["height"], r["width"], len(r["rgb"])) for r in rows] == [(1, 0, 12, 20, 720), (1, 1, 12, 20, 720)]


PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (5, None, "<p>same</p>"), (3, "http://a/3\r\nX: 1", None), (4, "u", ""), (6, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1"), (7, "u", "é" * 50_000), (None, "n", "<p>same</p>"), (None, "n", "null only"), (8, "u", "dup"), (8, "u", "dup")]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_come_back(spark, compression):
    df = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, payload_digest string")
    folder = shared_path(spark, "warc")
    W.write_archives(df, folder, compression)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.read_archives(spark, folder).collect()), key=str)
    same = W.payload_digest(b"<p>same</p>")
    d = lambda x: (len(x), W.payload_digest(x))
    want = [(1, 11, same, "revisit", 5), (2, 11, same, "revisit", 5), (5, 11, same, "response", None), (None, 11, same, "revisit", 5), (3, *d(b""), "revisit", 4), (4, *d(b""), "response", None)]
    want += [(6, *d(PAGES[5][2].encode()), "response", None), (7, *d(PAGES[6][2].encode()), "response", None), (None, *d(b"null only"), "response", None)] + [(8, *d(b"dup"), "response", None)] * 2
    assert got == sorted(want, key=str)


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string")
    assert W.with_revisits(df, least_bytes=12).where("record_type = 'revisit'").count() == 0


def test_filters_skip_payloads(spark):
    folder = shared_path(spark, "warc")
    W.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), folder)
    W.register(spark)
    rows = spark.read.format("warc").schema("page_id string, record_type string").load(folder).where("record_type = 'revisit' and page_id = '2'")
    assert [tuple(r) for r in rows.collect()] == [("2", "revisit")]
    reader = W.WarcReader(spark.createDataFrame([], W.SCHEMA).schema, {"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("offset",), 3)]))
    assert len(left) == 1 and reader.wanted({"warc-type": "response"}) and not reader.wanted({"warc-type": "revisit"})


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_reader_jumps_over_unwanted_payloads(monkeypatch):
    monkeypatch.setattr(W, "_STEP", 4096)
    big = random.Random(1).randbytes(3 << 20)
    fields = [("WARC-Type", "response")]
    for pack in (bytes, W.gzip_member):
        data = b"".join(pack(W.record(fields, big)) for _ in range(3)) + pack(W.record([("WARC-Type", "revisit")], b""))
        file = Counting(data)
        got = list(W.records(file, lambda f: f["warc-type"] == "revisit", True))
        assert [f["warc-type"] for _, f, _ in got] == ["revisit"] and file.taken < 100_000
    whole = b"".join(gzip.compress(W.record(fields, big)) for _ in range(2))  # members that do not tell their length
    assert [p == big for _, _, p in W.records(io.BytesIO(whole), lambda f: True, True)] == [True, True]
    assert [p for _, _, p in W.records(io.BytesIO(whole), lambda f: True, False)] == [None, None]


def test_damaged_payload_is_found(spark, tmp_path):
    bad = W.record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + W.payload_digest(b"good"))], b"evil")
    (tmp_path / "x.warc").write_bytes(bad)
    W.register(spark)
    with pytest.raises(Exception, match="does not have the digest"):
        spark.read.format("warc").load(str(tmp_path)).collect()
    assert spark.read.format("warc").option("verify", "false").load(str(tmp_path)).count() == 1


def test_archives_of_nothing(spark):
    folder = shared_path(spark, "warc")
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert W.read_archives(spark, folder).select(F.col("page_id")).count() == 0


def test_scans_share_one_layout_of_blocks(monkeypatch):
    made, copied = [], []
    own, blocks = J._Layout.__init__, J._Layout.blocks
    monkeypatch.setattr(J._Layout, "__init__", lambda self, image, named: (made.append(bytes(named)), own(self, image, named))[1])
    monkeypatch.setattr(J._Layout, "blocks", lambda self, depth: (copied.append(depth), blocks(self, depth))[1])
    payload = bytes(random.Random(5).randrange(256) for _ in range(64 * 77))
    image, = M.images(M.encode_payload(payload))
    assert M.payload_of(image) == payload
    # 27 scans over four choices of components; the eight that refine DC coefficients work in place
    assert sorted(made) == [b"\1", b"\1\2\3", b"\2", b"\3"] and len(copied) == 19


def test_refining_scans_are_taken_together(monkeypatch):
    """Scans that refine the same coefficients bit after bit cost one step, not one each; the first scans stay alone."""
    alone = []
    scan = J._scan
    monkeypatch.setattr(J, "_scan", lambda *args: (alone.append(1), scan(*args)))
    for blocks in (1, 7, 300):
        alone.clear()
        payload = random.Random(blocks).randbytes(64 * blocks)
        assert M.payload_of(next(M.images(M.encode_payload(payload)))) == payload
        assert len(alone) == 5  # of 27
