"""Media columns: baseline JPEG written, parsed, Huffman-decoded and hashed in numpy.

``store_payload`` turns any bytes into one grey baseline JPEG without loss.  Each
byte is the DC coefficient of one flat 8 x 8 block (quantiser 8, so a block's
pixels equal the byte), 24 blocks to a restart interval.  The DC table gives
category s a code of 9 - s bits, so that every difference takes 9 bits; with the
one-bit end-of-block an interval is exactly 30 bytes before stuffing.  A row is
one interval, or as many as keep the frame within 8,191 rows; the last row is
filled up with 255.  A comment segment states the payload's length.  A frame
holds 64 MB; only a longer payload, for which the format has no room, goes on in
a further frame.

``decode_dc`` reads any baseline JPEG: it walks the markers, builds the Huffman
tables from the file, and decodes the restart intervals of the scan side by
side, one symbol of every interval at a time.  Only DC values are kept; they
give the luminance thumbnail with one sample to a block.

Nulls and empty texts are empty payloads.  A payload is never cut.  Repeated rows
are each stored, and equal payloads give equal media.  ``media_features`` gives a
medium that is no sound baseline JPEG (progressive, truncated, damaged) null
features and says why in ``error``; a null medium has nulls in all of them.  Only
the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from storelens.llm.blocks import text_bytes

UNIT, INTERVAL, INTERVAL_BYTES = 576, 24, 30
#: Blocks along either side of a frame, whose sides have at most 65,535 pixels.
SIDE = 8191
FRAME_BYTES = SIDE // INTERVAL * INTERVAL * SIDE
_DC_CATEGORIES = list(range(8, -1, -1))


def _dht(kind: int, lengths: list[int], symbols: list[int]) -> bytes:
    body = bytes([kind, *lengths, *symbols])
    return b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body


#: Codes of 1 to 9 bits, one for each of the categories 8 to 0; AC has the end-of-block alone.
_TABLES = _dht(0x00, [1] * 9 + [0] * 7, _DC_CATEGORIES) + _dht(0x10, [1] + [0] * 15, [0])
_QUANTISER = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
_SCAN = b"\xff\xdd" + struct.pack(">HH", 4, INTERVAL) + b"\xff\xda" + bytes([0, 8, 1, 1, 0, 0, 63, 0])


def _frame_header(rows: int, across: int, payload: int) -> bytes:
    size = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, rows * 8, across * INTERVAL * 8, 1) + bytes([1, 0x11, 0])
    note = b"payload bytes %d" % payload
    return b"\xff\xd8\xff\xfe" + struct.pack(">H", 2 + len(note)) + note + _QUANTISER + size + _TABLES + _SCAN


def _difference_codes() -> np.ndarray:
    """The 9 bits of every difference -255..255, then the end-of-block bit 0, by difference + 255."""
    out = np.zeros(511, dtype=np.uint64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1 if s < 8 else 0  # 8 - s ones and a zero
        magnitude = d if d >= 0 else d + (1 << s) - 1
        out[d + 255] = ((prefix << s) | magnitude) << 1
    return out


_CODES = _difference_codes()


def encode_intervals(payload: np.ndarray) -> np.ndarray:
    """Entropy-coded intervals (n, 32): 30 bytes of code, then a restart marker; unstuffed."""
    samples = payload.reshape(-1, INTERVAL).astype(np.int16) - 128
    steps = np.diff(samples, axis=1, prepend=np.int16(0))
    codes = _CODES[steps + 255].reshape(-1, 6, 4)
    forty = codes[:, :, 0] << np.uint64(30) | codes[:, :, 1] << np.uint64(20) | codes[:, :, 2] << np.uint64(10) | codes[:, :, 3]
    out = np.empty((len(samples), 32), dtype=np.uint8)
    out[:, :INTERVAL_BYTES] = forty.astype(">u8").view(np.uint8).reshape(-1, 6, 8)[:, :, 3:].reshape(-1, INTERVAL_BYTES)
    out[:, 30] = 0xFF
    return out


def _store_frame(payload: np.ndarray) -> bytes:
    intervals = len(payload) // INTERVAL
    across = -(-intervals // SIDE)
    rows = -(-intervals // across)
    filled = np.full(rows * across * INTERVAL, 255, dtype=np.uint8)
    filled[: len(payload)] = payload
    coded = encode_intervals(filled)
    coded[:, 31] = 0xD0 + (np.arange(len(coded)) & 7)
    coded[-1, 31] = 0xD9
    flat = coded.reshape(-1)
    stuffed = flat == 0xFF
    stuffed.reshape(-1, 32)[:, 30] = False
    scan = np.insert(flat, np.flatnonzero(stuffed) + 1, 0) if stuffed.any() else flat
    return _frame_header(rows, across, len(payload)) + scan.tobytes()


def store_payload(payload: np.ndarray) -> bytes:
    """The JPEG of one padded payload."""
    return b"".join(_store_frame(payload[a : a + FRAME_BYTES]) for a in range(0, len(payload), FRAME_BYTES))


def pad(text: bytes) -> np.ndarray:
    """The text's bytes, then bytes 255 up to a positive multiple of UNIT."""
    out = np.full(max(1, -(-len(text) // UNIT)) * UNIT, 255, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out


class Frame:
    """One parsed JPEG frame: size, components, tables and where its scan lies."""

    def __init__(self) -> None:
        self.width = self.height = self.restart = 0
        self.components: list[tuple[int, int, int]] = []  # horizontal and vertical sampling, quantiser
        self.tables: dict[int, bytes] = {}  # number -> the table's own definition: code counts and symbols
        self.dc_quantisers: dict[int, int] = {}
        self.selected: list[tuple[int, int]] = []
        self.scan = (0, 0)
        self.payload: int | None = None  # how many samples the comment counts


def _huffman(definition: bytes) -> np.ndarray:
    """For every 16 bits ahead: symbol * 32 + code length; 0 where no code fits."""
    lengths, symbols = definition[:16], definition[16:]
    out = np.zeros(1 << 16, dtype=np.int32)
    code, k = 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            at = code << (16 - bits)
            out[at : at + (1 << (16 - bits))] = symbols[k] * 32 + bits
            code, k = code + 1, k + 1
        code <<= 1
    return out


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)
_NOTE = re.compile(rb"payload bytes (\d{1,18})")


class Tables:
    """Decoding tables of the Huffman definitions met last, at most ``most`` of each kind."""

    def __init__(self, most: int = 16):
        self.most = most
        self.single: dict[bytes, np.ndarray] = {}
        self.pairs: dict[tuple[bytes, bytes], np.ndarray] = {}

    def huffman(self, definition: bytes) -> np.ndarray:
        if definition not in self.single:
            if len(self.single) >= self.most:
                self.single.clear()
            self.single[definition] = _huffman(definition)
        return self.single[definition]

    def fused(self, dc: bytes, ac: bytes) -> np.ndarray:
        if (dc, ac) not in self.pairs:
            if len(self.pairs) >= self.most:
                self.pairs.clear()
            self.pairs[dc, ac] = _fused(self.huffman(dc), self.huffman(ac))
        return self.pairs[dc, ac]


def parse_frames(media: bytes) -> Iterator[Frame]:
    """Walks the markers of concatenated baseline JPEGs."""
    at, frame = 0, Frame()
    while at + 4 <= len(media) or media[at : at + 2] == b"\xff\xd8":
        if media[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        kind = media[at + 1]
        if kind == 0xD8:
            at, frame = at + 2, Frame()
            continue
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", media[at + 2 : at + 4])[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                frame.dc_quantisers[body[k] & 15] = struct.unpack(">H", body[k + 1 : k + 3])[0] if wide else body[k + 1]
                k += 1 + 64 * (1 + wide)
        elif kind == 0xC0:
            frame.height, frame.width = struct.unpack(">HH", body[1:5])
            frame.components = [(body[6 + 3 * i + 1] >> 4, body[6 + 3 * i + 1] & 15, body[6 + 3 * i + 2]) for i in range(body[5])]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG is read")
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                frame.tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif kind == 0xFE:
            note = _NOTE.fullmatch(body)
            frame.payload = int(note[1]) if note else None
        elif kind == 0xDD:
            frame.restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            frame.selected = [(body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])]
            begin, end = at, _SCAN_END.search(media, at)
            at = end.start() if end else len(media)
            frame.scan = (begin, at)
            yield frame
            at += 2


def _fused(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """For every 16 bits ahead that hold a whole DC difference and the end of the block: difference * 64 + bits; else 0."""
    window = np.arange(1 << 16, dtype=np.int64)
    used, size = dc & 31, dc >> 5
    taken = used + size
    fits = (used > 0) & (taken < 16)
    value = (window >> np.maximum(16 - taken, 0)) & ((1 << size) - 1)
    value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
    after = ac[(window << np.minimum(taken, 16)) & 0xFFFF]
    fits &= (after > 0) & (after < 32) & (taken + (after & 31) <= 16)
    return np.where(fits, value * 64 + taken + (after & 31), 0)


def _layout(frame: Frame) -> tuple[list[int], int]:
    """(component of each block of an MCU, number of MCUs)."""
    if len(frame.components) == 1:
        return [0], -(-frame.width // 8) * -(-frame.height // 8)
    hmax, vmax = max(c[0] for c in frame.components), max(c[1] for c in frame.components)
    return [i for i, (h, v, _) in enumerate(frame.components) for _ in range(h * v)], -(-frame.width // (8 * hmax)) * -(-frame.height // (8 * vmax))


def _unstuffed(frame: Frame, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and restart markers, and where each interval begins in them."""
    raw = data[frame.scan[0] : frame.scan[1]]
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    follows = raw[ff + 1]
    restart = (follows >= 0xD0) & (follows <= 0xD7)
    gone = np.sort(np.concatenate((ff[follows == 0] + 1, ff[restart], ff[restart] + 1)))
    keep = np.ones(len(raw), dtype=bool)
    keep[gone] = False
    begins = np.concatenate(([0], ff[restart] + 2))
    return raw[keep], begins - np.searchsorted(gone, begins)


def decode_dc(frames: list[Frame], datas: list[np.ndarray], known: Tables | None = None) -> list[list[np.ndarray]]:
    """For each frame, the DC samples (dequantised, level-shifted) of every component in order of decoding.

    Intervals of all frames with the same tables and layout are decoded together.
    """
    known = known or Tables()
    out: list[list[np.ndarray]] = [[] for _ in frames]
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        layout, mcus = _layout(f)
        if mcus * len(layout) > 4 * (f.scan[1] - f.scan[0]):  # a block takes two bits at least
            raise ValueError("the scan is too short for the frame")
        tables = tuple((f.tables[d], f.tables[a]) for d, a in f.selected)
        groups.setdefault((tuple(layout), tables, f.restart or mcus), []).append(i)
    for (layout, tables, per), members in groups.items():
        scans = [_unstuffed(frames[i], datas[i]) for i in members]
        counts = [_layout(frames[i])[1] for i in members]
        lanes = [-(-n // per) for n in counts]
        clean = np.concatenate([*(s for s, _ in scans), np.full(16, 0xFF, dtype=np.uint8)])
        base = np.concatenate(([0], np.cumsum([len(s) for s, _ in scans])))
        if any(len(at) < n for (_, at), n in zip(scans, lanes, strict=True)):
            raise ValueError("restart intervals are missing")
        begin = np.concatenate([at[:n] + o for (_, at), n, o in zip(scans, lanes, base, strict=False)]).astype(np.int64)
        limit = np.concatenate([np.append(at[1:n], len(s)) + o for (s, at), n, o in zip(scans, lanes, base, strict=False)]).astype(np.int64)
        left = np.concatenate([np.minimum(per, n - per * np.arange(k)) for n, k in zip(counts, lanes, strict=True)])
        values = np.empty((len(begin), per, len(layout)), dtype=np.int16)
        for a in range(0, len(begin), LANES):
            b = min(a + LANES, len(begin))
            own = clean[begin[a] : limit[b - 1] + 16]  # the bytes of these intervals, and some to look ahead into
            ends = _decode_lanes(own, (begin[a:b] - begin[a]) * 8, left[a:b], layout, tables, values[a:b], known)
            if (ends > (limit[a:b] - begin[a]) * 8).any():
                raise ValueError("an interval ends too early")
        ends = np.cumsum(lanes)
        for i, n, k, end in zip(members, counts, lanes, ends, strict=True):
            own = values[end - k : end]
            for c, (_, _, q) in enumerate(frames[i].components):
                columns = [b for b, x in enumerate(layout) if x == c]
                dc = own[:, :, columns].reshape(-1)[: n * len(columns)]
                out[i].append(np.clip((dc * frames[i].dc_quantisers[q] + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return out


#: Intervals that are decoded side by side.
LANES = 1 << 16


def _decode_lanes(clean: np.ndarray, bit: np.ndarray, left: np.ndarray, layout: tuple[int, ...], tables: tuple[tuple[bytes, bytes], ...], values: np.ndarray, known: Tables) -> np.ndarray:
    """Fills values (lanes, MCUs, blocks) with DC values, one block of each lane a step; returns the bits where lanes end."""
    words = np.ndarray(shape=(len(clean) - 3,), dtype=">u4", buffer=clean.data, strides=(1,)).astype(np.int64)
    predictor = np.zeros((len(tables), len(bit)), dtype=np.int64)
    short = int(left.min())
    for m in range(values.shape[1]):
        live = np.flatnonzero(left > m) if m >= short else slice(None)
        for b, c in enumerate(layout):
            at = bit[live]
            entry = known.fused(*tables[c])[words[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
            step, moved = entry >> 6, at + (entry & 63)
            if not entry.all():
                odd = np.flatnonzero(entry == 0)
                step[odd], moved[odd] = _slow_block(clean, at[odd], known.huffman(tables[c][0]), known.huffman(tables[c][1]))
            predictor[c, live] += step
            values[live, m, b] = predictor[c, live]
            bit[live] = moved
    return bit


def _peek(clean: np.ndarray, at: np.ndarray) -> np.ndarray:
    """40 bits from bit position at."""
    byte = at >> 3
    word = clean[np.minimum(byte, len(clean) - 1)].astype(np.int64)
    for k in range(1, 6):
        word = word << 8 | clean[np.minimum(byte + k, len(clean) - 1)]
    return word >> (8 - (at & 7)) & 0xFFFFFFFFFF


def _slow_block(clean: np.ndarray, at: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(DC difference, bit position after the block) of blocks with AC coefficients or long codes."""
    window = _peek(clean, at)
    entry = dc[window >> 24]
    if not entry.all():
        raise ValueError("no Huffman code fits")
    size, used = entry >> 5, entry & 31
    value = (window >> (40 - used - size)) & ((1 << size.astype(np.int64)) - 1)
    value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
    at, k, live = at + used + size, np.ones(len(at), dtype=np.int64), np.arange(len(at))
    while len(live):
        entry = ac[_peek(clean, at[live]) >> 24]
        if not entry.all():
            raise ValueError("no Huffman code fits")
        symbol = entry >> 5
        at[live] += (entry & 31) + (symbol & 15)
        k[live] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
        live = live[k[live] < 64]
    return value, at


def thumbnail(frame: Frame, luminance: np.ndarray) -> np.ndarray:
    """The luminance samples as rows and columns of blocks, cut to the blocks the frame shows."""
    h, v, _ = frame.components[0]
    if len(frame.components) == 1:
        h = v = 1
    hmax = max(c[0] for c in frame.components) if len(frame.components) > 1 else 1
    vmax = max(c[1] for c in frame.components) if len(frame.components) > 1 else 1
    across, down = -(-frame.width // (8 * hmax)), -(-frame.height // (8 * vmax))
    grid = luminance.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return grid[: -(-frame.height * v // (8 * vmax)), : -(-frame.width * h // (8 * hmax))]


def average_hash(grid: np.ndarray) -> str:
    """64 bits, one to a cell of an 8 x 8 raster: is the cell's mean over the mean of all cells?"""
    rows = np.linspace(0, grid.shape[0], 9).astype(np.int64)[:-1]
    columns = np.linspace(0, grid.shape[1], 9).astype(np.int64)[:-1]
    tall = np.add.reduceat(grid, rows, axis=0, dtype=np.int64)
    cells = np.add.reduceat(tall, columns, axis=1)
    areas = np.outer(np.diff(np.append(rows, max(grid.shape[0], rows[-1] + 1))).clip(1), np.diff(np.append(columns, max(grid.shape[1], columns[-1] + 1))).clip(1))
    means = cells / areas
    return np.packbits(means > means.mean()).tobytes().hex()


def read_media(media: list[bytes], known: Tables | None = None) -> list[tuple[bytes, int, int, str]]:
    """(payload, width, total height, thumbnail hashes) of each medium; frames, where there are several, joined.

    The payload is the luminance DC samples, as many as the comment counts, or all.
    """
    frames, datas, owner = [], [], []
    for i, stored in enumerate(media):
        data = np.frombuffer(stored, dtype=np.uint8)
        found = list(parse_frames(stored))
        if not found:
            raise ValueError("no scan")
        for frame in found:
            frames.append(frame)
            datas.append(data)
            owner.append(i)
    out: list[list] = [[[], 0, 0, []] for _ in media]
    for i, frame, components in zip(owner, frames, decode_dc(frames, datas, known), strict=True):
        grid = thumbnail(frame, components[0])
        out[i][0].append(grid.tobytes()[: frame.payload])
        out[i][1], out[i][2] = max(out[i][1], frame.width), out[i][2] + frame.height
        out[i][3].append(average_hash(grid))
    return [(b"".join(s), w, h, "-".join(x)) for s, w, h, x in out]


#: What damaged bytes raise.
DAMAGE = (ValueError, IndexError, KeyError, TypeError, OverflowError, ZeroDivisionError, struct.error)


def _read_each(media: list[bytes], known: Tables) -> list[tuple[bytes, int, int, str] | str]:
    """As ``read_media``, with a message in place of a medium that is damaged; sound ones are read together."""
    try:
        return list(read_media(media, known))
    except DAMAGE as problem:
        if len(media) == 1:
            return [f"{type(problem).__name__}: {problem}"]
        half = len(media) // 2
        return _read_each(media[:half], known) + _read_each(media[half:], known)


MEDIA_SCHEMA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def with_media(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, n_bytes, media): every row's text or bytes as a lossless baseline JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            sizes = np.diff(starts)
            a = 0
            while a < len(sizes):  # hand over a few MB at a time
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + (8 << 20), side="right")) - 1)
                media = [store_payload(pad(data[starts[i] : starts[i + 1]].tobytes())) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes[a:b]), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])
                a = b

    return df.select(key, column).mapInArrow(run, T.StructType([df.schema[key], *MEDIA_SCHEMA]))


def media_features(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """keep plus FEATURE_SCHEMA from a column of baseline JPEGs; a null medium has null features, a damaged one an error too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tables()
        for batch in batches:
            column, out, a = batch.column(len(keep)), [], 0
            _, starts = text_bytes(column)
            while a < len(column):  # about a MB of media is decoded at a time
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + (1 << 20), side="right")) - 1)
                stored = column.slice(a, b - a).to_pylist()
                read = iter(_read_each([x for x in stored if x is not None], known))
                for x in stored:
                    if x is None:
                        out.append((None,) * len(FEATURE_SCHEMA))
                        continue
                    found = next(read)
                    own = (len(x), hashlib.sha256(x).hexdigest())
                    if isinstance(found, str):
                        out.append((None, None, None, *own, None, None, None, found))
                        continue
                    payload, width, height, hashes = found
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, width, height, f"{width}x{height}:{hashes}", None))
                a = b
            columns = list(zip(*out, strict=True)) if out else [[]] * len(FEATURE_SCHEMA)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keep, *FEATURE_SCHEMA.names])

    return df.select(*keep, media).mapInArrow(run, T.StructType([*(df.schema[k] for k in keep), *FEATURE_SCHEMA]))
