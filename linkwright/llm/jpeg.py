"""Media columns: baseline JPEG, written and read with numpy alone.

The decoder parses markers, splits the scan at its restart markers, and Huffman-decodes all parts of all
images of a chunk in step: each pass over the arrays decodes one symbol of every part. DC terms alone give the
luminance thumbnail, one pixel a block. Dimensions and thumbnail hashes are stored.

``encode_payload`` stores bytes losslessly in the format's own unit, the quantised coefficient: 64 bytes are
a block in zigzag order, each a coefficient of magnitude 128 to 255, whose eight magnitude bits are the byte. With
a restart marker after every block each DC term stands for itself. Width is at most ``ROW`` blocks, or more where the height
would be over ``MOST_SIDE``, the format's limit for both; blocks beyond the payload are zero bytes, and a comment holds the payload's length.

Nulls: a null text is an empty one, one block of zero bytes; a null or damaged image has null features in
``media_features`` and an ``error``. Empty table: no rows. Equal texts give equal media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkwright.llm.common import chunks, materialise, ready, spread, table

ROW = 64
BLOCK = 64
MOST_SIDE = 8191
MOST_BLOCKS = MOST_SIDE**2
CHUNK = 2 << 20
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE
PAYLOAD = b"payload "


def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block (row by row) of each term in scan order: along the antidiagonals, to and fro."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, symbol: int) -> bytes:
    """A Huffman table in which ``symbol`` has the one-bit code 0."""
    return _segment(DHT, bytes([kind << 4, 1, *[0] * 15, symbol]))


# --- writing -----------------------------------------------------------------------------------------------


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def _scan(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all blocks with a restart marker after each, and where each block ends."""
    eight = blocks.reshape(-1, 8).astype(np.uint16)
    coded = np.empty((len(eight), 9), np.uint8)  # eight times a code bit 0 and the byte
    for i in range(9):
        high = eight[:, i - 1] << (8 - i) if i else 0
        coded[:, i] = (high | (eight[:, i] >> (i + 1) if i < 8 else 0)) & 0xFF
    coded = coded.reshape(len(blocks), 72)
    stuffed = coded == 0xFF
    ends = np.cumsum(stuffed.sum(1) + 74)
    out = np.zeros(int(ends[-1]), np.uint8)
    shift = np.cumsum(stuffed.ravel()) - stuffed.ravel()
    at = np.arange(coded.size) + shift + 2 * np.repeat(np.arange(len(blocks)), 72)
    out[at] = coded.ravel()
    out[ends - 2] = 0xFF
    return out, ends


def shape_of(n: int) -> tuple[int, int]:
    """Blocks across and down for ``n`` blocks."""
    across = min(n, max(ROW, -(-n // MOST_SIDE)))
    return across, -(-n // across)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload (a positive multiple of 64 bytes)."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(n > MOST_BLOCKS for n in counts):
        raise ValueError(f"a payload has over {MOST_BLOCKS * BLOCK} bytes")
    shapes = [shape_of(n) for n in counts]
    full = b"".join(p + bytes((w * h - n) * BLOCK) for p, n, (w, h) in zip(payloads, counts, shapes))
    scan, ends = _scan(np.frombuffer(full, np.uint8).reshape(-1, BLOCK))
    out, block, start = [], 0, 0
    for p, (w, h) in zip(payloads, shapes):
        n = w * h
        own_ends = ends[block : block + n]
        own = scan[start : int(own_ends[-1])].copy()
        own[own_ends - start - 1] = 0xD0 + np.arange(n) % 8
        head = b"\xff\xd8" + _segment(COM, PAYLOAD + str(len(p)).encode()) + _segment(DQT, b"\0" + b"\1" * 64) + _segment(SOF0, struct.pack(">BHHB3B", 8, 8 * h, 8 * w, 1, 1, 0x11, 0)) + _one_code(0, 8) + _one_code(1, 8) + _segment(DRI, struct.pack(">H", 1)) + _segment(SOS, bytes([1, 1, 0, 0, 63, 0]))
        out.append(head + own[:-2].tobytes() + b"\xff\xd9")  # no restart marker after the last block
        block, start = block + n, int(own_ends[-1])
    return out


# --- reading -----------------------------------------------------------------------------------------------


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC table, AC table
    restart: int = 0
    comments: list[bytes] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)

    def units(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.scan) == 1:
            return [0]
        return [i for i, (c, _, _) in enumerate(self.scan) for _ in range(self.components[c][1] * self.components[c][2])]

    def mcus(self) -> tuple[int, int]:
        """MCUs across and down."""
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.scan) == 1:  # blocks of the one component
            _, ch, cv, _ = self.components[self.scan[0][0]]
            return -(-(-(-self.width * ch // h)) // 8), -(-(-(-self.height * cv // v)) // 8)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Image:
    """Markers and entropy-coded parts of a baseline JPEG of one scan; raises ``ValueError`` on anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("a segment is cut off")
        at += 2 + size
        if marker == DQT:
            while body:
                wide, t = body[0] >> 4, body[0] & 15
                image.quant[t] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + 64 * (wide + 1) :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                image.tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == SOF0:
            depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not image.height or not image.width:
                raise ValueError("not eight bits, or no size")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == DRI:
            image.restart = int.from_bytes(body[:2], "big")
        elif marker == COM:
            image.comments.append(body)
        elif marker == SOS:
            ids = [c[0] for c in image.components]
            image.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    raw = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    stops = ff[(after != 0) & (after != 0xFF)]
    kinds = raw[stops + 1]
    last = np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))
    if not len(last):
        raise ValueError("the end is missing")
    stops = stops[: last[0] + 1]
    keep = np.ones(int(stops[-1]), bool)
    keep[(ff + 1)[(after == 0) & (ff + 1 < stops[-1])]] = False  # stuffed zeros
    image.parts = []
    start = 0
    clean = np.cumsum(keep) - keep
    bytes_ = raw[: stops[-1]][keep]
    for stop in stops.tolist():
        a = int(clean[start]) if start < len(clean) else len(bytes_)
        b = int(clean[stop]) if stop < len(clean) else len(bytes_)
        image.parts.append(bytes_[a:b].tobytes())
        start = stop + 2
    return image


@lru_cache(256)
def _lookup(spec: bytes) -> np.ndarray:
    """For every 16 bits that may come next: code length << 8 | symbol, or 0 where there is no such code."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """(blocks, 64) quantised terms of each image in scan order; parts of all images are decoded in step."""
    tables: dict[bytes, int] = {}
    starts, first, left, image_of, units_of, out_at = [], [], [], [], [], 0
    buffers, at, bases = [], 0, []
    for n, image in enumerate(images):
        units = image.units()
        across, down = image.mcus()
        total, per = across * down, image.restart or across * down
        bases.append(out_at)
        if len(image.parts) != -(-total // per):
            raise ValueError("restart markers are missing")
        for k, part in enumerate(image.parts):
            starts.append(8 * at)
            first.append(out_at + k * per * len(units))
            left.append(min(per, total - k * per) * len(units))
            image_of.append(n)
            buffers.append(part)
            at += len(part) + 4
            buffers.append(b"\xff\xff\xff\xff")
        out_at += total * len(units)
        spec = [(tables.setdefault(image.tables[d], len(tables)), tables.setdefault(image.tables[0x10 | a], len(tables)), i) for i in units for _, d, a in [image.scan[i]]]
        units_of.append(spec)
    data = np.frombuffer(b"".join(buffers) + bytes(4), np.uint8).astype(np.uint32)
    words = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    lookup = np.concatenate([_lookup(t) for t in tables])
    most = max(map(len, units_of))
    spec = np.array([u + [u[0]] * (most - len(u)) for u in units_of])  # image, unit, (DC, AC, component)
    n_units = np.array([len(u) for u in units_of])
    terms = np.zeros((out_at, 64), np.int16)
    pos, block, todo, image_n = (np.array(x, np.int64) for x in (starts, first, left, image_of))
    limit = np.array([s + 8 * (len(p) + 1) for s, p in zip(starts, buffers[::2])], np.int64)
    k, unit = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    previous = np.zeros((len(pos), 4), np.int64)
    lane = np.arange(len(pos))
    alike = most == 1 and len(units_of) and (spec == spec[0]).all()
    while len(pos):
        is_dc = k == 0
        own = (spec[0, 0],) if alike else (spec[image_n, unit].T,)
        dc, ac, component = own[0]
        window = words[pos >> 3] >> (8 - (pos & 7)).astype(np.uint32) & 0xFFFF
        code = lookup[np.where(is_dc, dc, ac) * 65536 + window]
        if not code.all():
            raise ValueError("no such code")
        pos = pos + (code >> 8)
        size = code & 15
        run = np.where(is_dc, 0, code >> 4 & 15)
        more = (words[pos >> 3] >> (8 - (pos & 7)).astype(np.uint32) & 0xFFFF).astype(np.int64) >> (16 - size)
        value = np.where(more >> np.maximum(size - 1, 0) & 1, more, more - (1 << size) + 1) * (size > 0)
        pos += size
        if is_dc.any():
            value = np.where(is_dc, value + previous[lane, component], value)
            previous[lane[is_dc], component if alike else component[is_dc]] = value[is_dc]
        end = ~is_dc & (size == 0) & (run != 15)
        k = k + run
        if (k > 63).any() or (pos > limit).any():
            raise ValueError("too many terms")
        terms[block, k] = value * ~end
        k = np.where(end, 64, k + 1)
        done = k == 64
        if done.any():
            k[done] = 0
            block = block + done
            todo = todo - done
            if not alike:
                unit = np.where(done, (unit + 1) % n_units[image_n], unit)
            if not todo.all():
                on = todo > 0
                pos, block, todo, image_n, k, unit, lane, limit = (x[on] for x in (pos, block, todo, image_n, k, unit, lane, limit))
    return [terms[a:b] for a, b in zip(bases, [*bases[1:], out_at])]


def thumbnail(image: Image, terms: np.ndarray) -> np.ndarray:
    """Luminance from DC terms alone: one pixel for each 8 x 8 block of the first component."""
    c, h, v, q = image.components[image.scan[0][0]]
    across, down = image.mcus()
    units = image.units()
    dc = terms[:, 0].astype(np.int64).reshape(down, across, len(units))
    if len(image.scan) > 1:
        dc = dc[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    else:
        dc = dc[:, :, 0]
    most_h, most_v = max(x[1] for x in image.components), max(x[2] for x in image.components)
    rows, columns = -(-(-(-image.height * v // most_v)) // 8), -(-(-(-image.width * h // most_h)) // 8)
    quant = int(image.quant[q][0])
    return np.clip((dc[:rows, :columns] * quant + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 sampled pixels is brighter than its neighbour on the left."""
    rows = np.arange(8) * pixels.shape[0] // 8
    columns = np.arange(9) * pixels.shape[1] // 9
    small = pixels[rows][:, columns].astype(np.int16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def payload_of(image: Image, terms: np.ndarray) -> bytes | None:
    """The bytes that ``encode_payloads`` stored; None for any other image."""
    size = next((int(c[len(PAYLOAD) :]) for c in image.comments if c.startswith(PAYLOAD)), None)
    if size is None:
        return None
    own = terms[: size // BLOCK].ravel()
    return np.where(own > 0, own, own + 255).astype(np.uint8).tobytes()


# --- columns -----------------------------------------------------------------------------------------------


def media_of_texts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_bytes, media): the whole text's bytes as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            for a, b in chunks(texts, CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(encode_payloads([pad(t) for t in texts[a:b]]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("thumbnail", "binary", pa.binary()), ("thumbnail_hash", "string", pa.string()), ("thumbnail_sha1", "string", pa.string()), ("payload", "binary", pa.binary()), ("error", "string", pa.string())]


def _features(media: list[bytes | None]) -> list[tuple]:
    images: list = []
    for m in media:
        try:
            images.append(parse(m) if m is not None else ValueError("null"))
        except (ValueError, IndexError, struct.error) as e:
            images.append(e)
    good = [x for x in images if isinstance(x, Image)]
    try:
        terms = iter(coefficients(good) if good else [])
    except (ValueError, KeyError, IndexError):  # one of them is damaged: each by itself
        own = []
        for i, x in enumerate(images):
            if isinstance(x, Image):
                try:
                    own += coefficients([x])
                except (ValueError, KeyError, IndexError) as e:
                    images[i] = ValueError(str(e))
        terms = iter(own)
    rows = []
    for x in images:
        if not isinstance(x, Image):
            rows.append((None,) * 6 + (str(x),))
            continue
        own = next(terms)
        pixels = thumbnail(x, own)
        rows.append((x.width, x.height, pixels.tobytes(), difference_hash(pixels), hashlib.sha1(pixels.tobytes()).hexdigest(), payload_of(x, own), None))
    return rows


def media_features(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Decodes ``column`` and returns the columns ``keep`` with dimensions, DC-only thumbnail, its hashes and the payload."""
    source = media.select(*keep, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in chunks(own, CHUNK):
                columns = zip(*_features(own[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(c, t) for c, (_, _, t) in zip(columns, FEATURES)], names=[*keep, *(n for n, _, _ in FEATURES)])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]] + [f"{n} {t}" for n, t, _ in FEATURES])
    return source.mapInArrow(run, schema)


def op3_jpeg_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    media = materialise(media_of_texts(table(spark, sf_dir, "documents")), "media")  # stored; what follows reads the stored bytes
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, sizes, stored = (batch.column(i) for i in range(3))
            stored = stored.to_pylist()
            for a, b in chunks(stored, CHUNK):
                rows = []
                for m, (width, height, _, near, exact, payload, error) in zip(stored[a:b], _features(stored[a:b])):
                    if error:
                        raise ValueError(error)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), f"{width}x{height}:{near}:{exact}", width, height))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), sizes.slice(a, b - a)] + [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return media.mapInArrow(run, schema)
