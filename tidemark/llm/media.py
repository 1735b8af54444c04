"""Baseline JPEG media columns.

``encode_media`` stores bytes losslessly in a baseline JPEG: one byte is the DC coefficient of one 8x8 luminance block
(quantiser 8, so the flat block has that very sample value). A restart interval of 576 blocks makes the entropy-coded
segments independent. Payloads past a JPEG's largest height go on in further images, one after the other.

``read_jpegs`` is a general baseline reader for DC-only thumbnails: it parses the markers, takes any Huffman and
quantisation tables, component sampling, AC coefficients and restart intervals, and decodes all segments of all images
side by side in numpy, one symbol of each at a time. AC coefficients are skipped over; what comes back are the
luminance DC samples, that is the image at an eighth of its size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.texts import id_type, map_batches, utf8
from tidemark.sources.tables import pick

UNIT = 576
ROWS_MOST = 8191  # 65,528 lines of samples
#: Payload bytes that are coded at once.
BLOCK_BYTES = 1 << 21

# Code lengths and symbols of the DC table (categories 0 to 8) and the AC table (end of block only).
DC_LENGTHS = (0, 1, 3, 3, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (6, 4, 5, 7, 0, 2, 3, 1, 8)
AC_LENGTHS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def canonical(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits) of a DHT table."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(maxsize=1)
def difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference plus 255: the bits of its whole block (category, value, end of block) and their number."""
    dc, (eob, eob_bits) = canonical(DC_LENGTHS, DC_SYMBOLS), canonical(AC_LENGTHS, AC_SYMBOLS)[0]
    codes, sizes = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, bits = dc[size]
        value = d if d >= 0 else d + (1 << size) - 1
        codes[d + 255] = (code << size | value) << eob_bits | eob
        sizes[d + 255] = bits + size + eob_bits
    return codes, sizes


def header(rows: int) -> bytes:
    """All markers before the first entropy-coded segment of an image of 576 x ``rows`` blocks."""

    def part(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 255, marker, len(body) + 2) + body

    tables = b"".join(part(0xC4, bytes([kind, *lengths, *symbols])) for kind, lengths, symbols in ((0, DC_LENGTHS, DC_SYMBOLS), (16, AC_LENGTHS, AC_SYMBOLS)))
    return b"\xff\xd8" + part(0xDB, b"\0" + bytes([8] * 64)) + part(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * UNIT, 1) + b"\1\x11\0") + tables + part(0xDD, struct.pack(">H", UNIT)) + part(0xDA, b"\1\1\0\0\x3f\0")


def entropy_segments(units: np.ndarray) -> list[bytes]:
    """The stuffed entropy-coded bytes of each row of an (n, 576) array of samples."""
    codes, sizes = difference_codes()
    diff = np.diff(units.astype(np.int16), axis=1, prepend=128).astype(np.int64) + 255
    bits = sizes[diff]
    ends = bits.cumsum(axis=1)
    n_bytes = -(-ends[:, -1] // 8)
    base = np.concatenate([[0], n_bytes.cumsum()])
    at = (ends - bits + base[:-1, None] * 8).ravel()
    bits = bits.ravel()
    word = codes[diff.ravel()] << (32 - bits - (at & 7)).astype(np.uint64)
    out = np.zeros(base[-1] + 4, np.int64)
    for k in range(4):
        out += np.bincount((at >> 3) + k, weights=(word >> np.uint64(24 - 8 * k) & np.uint64(255)).astype(float), minlength=len(out)).astype(np.int64)[: len(out)]
    pad = base[1:] * 8 - (ends[:, -1] + base[:-1] * 8)
    out[base[1:] - 1] += (1 << pad) - 1
    raw = out[: base[-1]].astype(np.uint8).tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\0") for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def to_jpegs(payloads: list[bytes]) -> list[bytes]:
    """Store payloads (positive multiples of 576 bytes) as baseline JPEGs."""
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    step = BLOCK_BYTES // UNIT
    segments = [s for at in range(0, len(flat), step) for s in entropy_segments(flat[at : at + step])]
    out, at = [], 0
    for p in payloads:
        parts, rows = [], len(p) // UNIT
        while rows:
            n = min(rows, ROWS_MOST)
            parts.append(header(n))
            for k in range(n):
                parts += (segments[at + k], b"\xff" + bytes([0xD0 + k % 8]) if k < n - 1 else b"\xff\xd9")
            at, rows = at + n, rows - n
        out.append(b"".join(parts))
    return out


@dataclass
class Frame:
    """What the markers of one image say, and its entropy-coded segments."""

    width: int
    height: int
    components: list[tuple[int, int, int]]  # horizontal and vertical sampling, quantiser of DC
    scan: list[tuple[int, int, int]]  # component number, DC table, AC table
    tables: dict[int, tuple[tuple[int, ...], tuple[int, ...]]]
    interval: int
    segments: list[bytes]

    @property
    def mcus(self) -> tuple[int, int]:
        """Columns and rows of minimum coded units."""
        h, v = max(c[0] for c in self.components), max(c[1] for c in self.components)
        if len(self.scan) == 1:
            own = self.components[self.scan[0][0]]
            return -(-self.width * own[0] // (8 * h)), -(-self.height * own[1] // (8 * v))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse_frames(data: bytes) -> list[Frame]:
    """Parse one or more baseline JPEGs; of an image's scans, the first that holds luminance counts."""
    frames, at, now = [], 0, None
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        at += 2
        if marker == 0xD8:
            now, quant, tables, interval, ids = Frame(0, 0, [], [], {}, 0, []), {}, {}, 0, []
            continue
        if marker == 0xD9:
            frames.append(now)
            continue
        if marker == 0xFF:
            at -= 1
            continue
        size = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            now.height, now.width, n = struct.unpack_from(">HHB", body, 1)
            ids = [body[6 + 3 * k] for k in range(n)]
            now.components = [(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            parts, begin = [], at
            while True:
                at = data.index(b"\xff", at)
                code = data[at + 1]
                if code == 0:
                    at += 2
                elif 0xD0 <= code <= 0xD7:
                    parts.append(data[begin:at])
                    at = begin = at + 2
                else:
                    parts.append(data[begin:at])
                    break
            if not now.segments and any(c == 0 for c, _, _ in scan):
                now.scan, now.tables, now.interval, now.segments = scan, dict(tables), interval, parts
                now.components = [(h, v, quant.get(q, q)) for h, v, q in now.components]
    return frames


def lookup(table: tuple[tuple[int, ...], tuple[int, ...]]) -> np.ndarray:
    """For the next 16 bits: symbol and code length (0: no such code) as symbol << 8 | length."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, bits) in canonical(*table).items():
        out[code << 16 - bits : code + 1 << 16 - bits] = symbol << 8 | bits
    return out


def decode_dc(segments: list[bytes], blocks: list[int], mcu: list[tuple[int, int, int]], tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """DC levels of segments that share tables and the blocks (component, DC table, AC table) of an MCU.

    All segments advance together, one Huffman symbol each a step. Returns (segments, most blocks) levels and the
    component of each block of an MCU.
    """
    raw = [s.replace(b"\xff\0", b"\xff") + b"\xff" * 8 for s in segments]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    windows = flat[:-7].copy()
    for k in range(1, 8):  # 64 bits from every byte on
        windows <<= np.uint64(8)
        windows |= flat[k : len(flat) - 7 + k]
    del flat
    size = np.array([len(r) for r in raw])
    limit = np.cumsum(size) * 8 - 64
    bit = np.cumsum(size) * 8 - size * 8
    book = np.stack([lookup(t) for t in tables.values()])
    row = {k: i for i, k in enumerate(tables)}
    comp = np.array([c for c, _, _ in mcu])
    dc_row, ac_row = np.array([row[d] for _, d, _ in mcu]), np.array([row[16 | a] for _, _, a in mcu])
    todo = np.array(blocks)
    levels = np.zeros((len(segments), int(todo.max(initial=0))), np.int32)
    pred = np.zeros((len(segments), int(comp.max()) + 1), np.int32)
    live, block, k = np.flatnonzero(todo > 0), np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
    one = len(mcu) == 1
    while len(live):
        b, pos, kk = bit[live], block[live], k[live]
        if (b > limit[live]).any():
            raise ValueError("an entropy-coded segment ends early")
        slot = np.zeros(len(live), np.int64) if one else pos % len(mcu)
        is_dc = kk == 0
        window = windows[b >> 3] << (b & 7).astype(np.uint64)
        found = book[np.where(is_dc, dc_row[slot], ac_row[slot]), (window >> np.uint64(48)).astype(np.int64)]
        length, symbol = found & 255, found >> 8
        if not length.all():
            raise ValueError("no such Huffman code")
        size_ = np.where(is_dc, symbol, symbol & 15)
        dc = np.flatnonzero(is_dc)
        s = size_[dc].astype(np.uint64)
        value = ((window[dc] << length[dc].astype(np.uint64)) >> np.uint64(32) >> (np.uint64(32) - s)).astype(np.int64)
        value = np.where(value < (1 << s.astype(np.int64) >> 1), value - (1 << s.astype(np.int64)) + 1, value)
        value[s == 0] = 0
        who = live[dc]
        pred[who, comp[slot[dc]]] += value.astype(np.int32)
        levels[who, pos[dc]] = pred[who, comp[slot[dc]]]
        bit[live] = b + length + size_
        kk = np.where(is_dc, 1, np.where(symbol == 0, 64, kk + (symbol >> 4) + 1))
        done = kk >= 64
        k[live] = np.where(done, 0, kk)
        block[live] = pos + done
        live = live[block[live] < todo[live]] if done.any() else live
    return levels, comp


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """The DC-only luminance samples of each frame, as (rows, columns) of 8-bit values."""
    out: list[np.ndarray | None] = [None] * len(frames)
    groups: dict = {}
    for i, f in enumerate(frames):
        key = (tuple(f.scan), tuple(f.components), tuple(sorted(f.tables.items())), len(f.scan) > 1)
        groups.setdefault(key, []).append(i)
    for key, members in groups.items():
        f = frames[members[0]]
        mcu = [(c, d, a) for c, d, a in f.scan for _ in range(1 if len(f.scan) == 1 else f.components[c][0] * f.components[c][1])]
        segments, blocks = [], []
        for i in members:
            cols, rows = frames[i].mcus
            left, every = cols * rows, frames[i].interval or cols * rows
            for s in frames[i].segments:
                segments.append(s)
                blocks.append(min(left, every) * len(mcu))
                left -= min(left, every)
            if left:
                raise ValueError("an image ends early")
        parts, at = [], 0
        while at < len(segments):  # a bounded number of bytes at a time
            end, held = at, 0
            while end < len(segments) and (end == at or held < BLOCK_BYTES):
                held += max(len(segments[end]), blocks[end])
                end += 1
            levels, comp = decode_dc(segments[at:end], blocks[at:end], mcu, dict(key[2]))
            parts += [levels[j, : blocks[at + j]] for j in range(end - at)]
            at = end
        at = 0
        luma = np.flatnonzero(comp == 0)
        for i in members:
            n = len(frames[i].segments)
            cols, rows = frames[i].mcus
            level = np.concatenate(parts[at : at + n]).reshape(rows, cols, len(mcu))[:, :, luma]
            h, v, q = frames[i].components[0] if len(f.scan) > 1 else (1, 1, frames[i].components[0][2])
            dc = level.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
            sample = np.clip((dc * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
            most_h, most_v = max(c[0] for c in frames[i].components), max(c[1] for c in frames[i].components)
            own = frames[i].components[0]
            out[i] = sample[: -(-frames[i].height * own[1] // (8 * most_v)), : -(-frames[i].width * own[0] // (8 * most_h))]
            at += n
    return out


def average_hash(image: np.ndarray) -> str:
    """64 bits, as hex: which cells of an 8 x 8 grid (by whole rows and columns) are brighter than the mean of all."""
    ys, xs = (np.linspace(0, n, 9).astype(int) for n in image.shape)
    cells = np.array([[image[a : max(b, a + 1), c : max(d, c + 1)].mean() if a < image.shape[0] and c < image.shape[1] else 0.0 for c, d in zip(xs, xs[1:], strict=False)] for a, b in zip(ys, ys[1:], strict=False)])
    return np.packbits((cells > cells.mean()).ravel()).tobytes().hex()


def pad(raw: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of 576."""
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def describe(media: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]], str]]:
    """For each stored value: its DC samples in order, the dimensions of its images, and the thumbnail hash."""
    frames = [parse_frames(m) for m in media]
    images = iter(thumbnails([f for own in frames for f in own]))
    out = []
    for own in frames:
        found = [next(images) for _ in own]
        whole = found[0] if len({f.shape[1] for f in found}) > 1 else np.concatenate(found)
        out.append((b"".join(f.tobytes() for f in found), [(f.width, f.height) for f in own], average_hash(whole)))
    return out


def groups_of(items: list[bytes], most: int) -> list[slice]:
    """Slices of consecutive items that hold about ``most`` bytes."""
    out, at, held = [], 0, 0
    for i, x in enumerate(items):
        held += len(x)
        if held >= most or i == len(items) - 1:
            out.append(slice(at, i + 1))
            at, held = i + 1, 0
    return out


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text, padded, as baseline JPEG. Null texts count as empty."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = utf8(batch.column(1))
        media = [m for g in groups_of(raw, BLOCK_BYTES) for m in to_jpegs([pad(r) for r in raw[g]])]
        return pa.record_batch([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(pick(docs, [(id_col, "doc_id"), (text_col, "text")]), each, f"doc_id {id_type(docs, id_col)}, n_bytes bigint, media binary")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as baseline JPEG, read the stored bytes back, and describe them.

    Returns one row per input row: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32`` (of the last 32
    payload bytes), ``media_bytes, media_sha256, feature`` (dimensions of each image and the thumbnail hash). The
    payload columns come from the decoded images. Null texts count as empty (576 bytes of 255). Repeated rows repeat;
    an empty table gives an empty result; other columns are ignored.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = utf8(batch.column(1))
        rows: list[tuple] = []
        for g in groups_of(raw, BLOCK_BYTES):
            media = to_jpegs([pad(r) for r in raw[g]])
            for stored, (payload, dims, digest) in zip(media, describe(media), strict=True):
                feature = ",".join(f"{w}x{h}" for w, h in dims) + ":" + digest
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch([batch.column(0), pa.array(map(len, raw), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(pick(docs, [(id_col, "doc_id"), (text_col, "text")]), each, f"doc_id {id_type(docs, id_col)}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
