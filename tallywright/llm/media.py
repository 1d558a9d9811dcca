"""Media columns as baseline JPEG: a writer that stores bytes without loss, and a reader that parses markers,
Huffman-decodes scans and keeps the DC terms as a luminance thumbnail.

The writer's unit is the format's own: a quantised DC coefficient. Payload byte b is one 8x8 block whose DC
coefficient is b - 128 and whose AC coefficients are zero, with a quantiser of 8, so its grey level is b. Blocks
stand 24 to a row; restart markers follow every two rows. A payload longer than a frame's limit goes on in a
further JPEG frame, appended to the first.

The reader takes any baseline JPEG (8-bit, Huffman, one interleaved or several single scans, any sampling) and
decodes the restart intervals of many images side by side in numpy. Dimensions are those of the frame header;
thumbnails are the blocks' mean grey levels, dequantised. Other files, broken, cut short or null, give nulls and an
``error``, and spoil none of their neighbours; what is set aside for a file is bounded by its length.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Payloads are padded with blanks to a positive multiple of this.
UNIT = 192
COLUMNS = 24
#: Block rows of a frame: heights in pixels have 16 bits.
FRAME_BYTES = COLUMNS * 8184
#: Blocks between restart markers.
INTERVAL = 48

#: The code lengths and categories of the format's usual luminance DC table.
DC_LENGTHS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
#: The only AC symbol is "end of block", with a code of one bit.
AC_LENGTHS = [1] + [0] * 15
AC_SYMBOLS = [0]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def codes(lengths: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(code, bits, symbol) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out.append((code, bits, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    tables = b"".join(_segment(0xC4, bytes([kind]) + bytes(lengths) + bytes(symbols)) for kind, lengths, symbols in ((0, DC_LENGTHS, DC_SYMBOLS), (0x10, AC_LENGTHS, AC_SYMBOLS)))
    frame = _segment(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (COLUMNS * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00")
    return b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x08" * 64) + frame + tables + _segment(0xDD, INTERVAL.to_bytes(2, "big")) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


_DC_CODE = np.zeros(12, dtype=np.uint64)
_DC_BITS = np.zeros(12, dtype=np.int64)
for _code, _bits, _symbol in codes(DC_LENGTHS, DC_SYMBOLS):
    _DC_CODE[_symbol], _DC_BITS[_symbol] = _code, _bits
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)])


def write_jpegs(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of UNIT bytes) as one or more JPEG frames; all payloads are coded together."""
    frames = [p[i : i + FRAME_BYTES] for p in payloads for i in range(0, len(p), FRAME_BYTES)]
    level = np.frombuffer(b"".join(frames), dtype=np.uint8).astype(np.int64) - 128
    if not len(level):
        return [b"" for _ in payloads]
    parts = -(-np.array([len(f) for f in frames]) // INTERVAL)  # UNIT is a multiple of INTERVAL: no interval is short
    before = np.roll(level, 1)
    before[::INTERVAL] = 0
    diff = level - before
    size = _CATEGORY[diff + 255]
    value = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    bits = _DC_BITS[size] + size + 1
    word = (_DC_CODE[size] << size.astype(np.uint64) | value) << np.uint64(1)  # the last bit: end of block
    grid = bits.reshape(-1, INTERVAL)
    ends = np.cumsum(grid, axis=1)
    length = -(-ends[:, -1] // 8)
    offset = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length, out=offset[1:])
    start = ((ends - grid) + offset[:-1, None] * 8).ravel()
    # At most 7 + 18 bits: each code touches four bytes at most.
    spread = word << (np.uint64(32) - (start & 7).astype(np.uint64) - bits.astype(np.uint64))
    first_byte = start >> 3
    out = np.zeros(offset[-1] + 4, dtype=np.uint8)
    for k in range(4):  # codes share bytes but no bits, so sums are unions
        byte = (spread >> np.uint64(24 - 8 * k) & np.uint64(255)).astype(np.float64)
        out[k:] += np.bincount(first_byte, byte, len(out) - k)[: len(out) - k].astype(np.uint8)
    pad = (8 - (ends[:, -1] & 7)) & 7
    out[offset[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # Stuff a zero after each 0xFF and put restart markers between the intervals of a frame.
    data = out[: offset[-1]]
    first = np.zeros(len(frames) + 1, dtype=np.int64)
    np.cumsum(parts, out=first[1:])
    index = np.arange(len(length)) - np.repeat(first[:-1], parts)
    at = np.flatnonzero(data == 255) + 1
    marked = np.flatnonzero(index > 0)
    places = np.concatenate([at, np.repeat(offset[marked], 2)])
    values = np.concatenate([np.zeros(len(at), np.uint8), np.stack([np.full(len(marked), 255), 0xD0 + (index[marked] - 1) % 8], axis=1).ravel().astype(np.uint8)])
    coded = np.insert(data, places, values)
    cut = offset[first]
    cut = cut + np.searchsorted(np.sort(places), cut, side="right")  # a stuffed zero or marker at a cut belongs to what stands before
    made, k = [], 0
    for p in payloads:
        body = b""
        for i in range(0, len(p), FRAME_BYTES):
            body += _header(len(p[i : i + FRAME_BYTES]) // COLUMNS) + coded[cut[k] : cut[k + 1]].tobytes() + b"\xff\xd9"
            k += 1
        made.append(body)
    return made


@dataclass
class Frame:
    """A parsed JPEG frame; scans are (components, DHT tables then in force, restart interval, first and last byte of data)."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # DC step
    scans: list[tuple] = field(default_factory=list)


def _scan_end(data: bytes, at: int) -> int:
    """The place of the marker that ends entropy-coded data."""
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 1
    return len(data)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _frame_header(body: bytes) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    _need(len(body) >= 6 and len(body) == 6 + 3 * body[5] and 1 <= body[5] <= 4, "bad frame header")
    height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
    _need(body[0] == 8 and height > 0 and width > 0, "not an 8-bit frame of known size")
    components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
    _need(all(1 <= h <= 4 and 1 <= v <= 4 for _, h, v, _ in components), "bad sampling")
    _need(len({c[0] for c in components}) == len(components), "a component twice")
    return height, width, components


def _huffman_tables(body: bytes) -> dict[int, tuple]:
    out, k = {}, 0
    while k < len(body):
        lengths = tuple(body[k + 1 : k + 17])
        symbols = tuple(body[k + 17 : k + 17 + sum(lengths)])
        _need(len(lengths) == 16 and len(symbols) == sum(lengths), "Huffman table cut short")
        code = 0
        for bits, n in enumerate(lengths, 1):
            code += n
            _need(code <= 1 << bits, "Huffman table with too many codes")
            code <<= 1
        out[body[k]] = (lengths, symbols)
        k += 17 + sum(lengths)
    return out


def _quantisers(body: bytes) -> dict[int, int]:
    out, k = {}, 0
    while k < len(body):
        wide = body[k] >> 4
        _need(wide <= 1 and k + 1 + 64 * (1 + wide) <= len(body), "bad quantiser table")
        out[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
        k += 1 + 64 * (1 + wide)
    return out


def parse_frames(data: bytes) -> list[Frame]:
    """The frames of a file; raises ValueError where it is no baseline JPEG, or not whole."""
    frames: list[Frame] = []
    at = 0
    while at < len(data):
        _need(data[at : at + 2] == b"\xff\xd8", "no start marker")
        at += 2
        frame, tables, interval = Frame(), {}, 0
        while True:
            while at + 1 < len(data) and data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            _need(at + 2 <= len(data) and data[at] == 0xFF, "no marker where one is due")
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            n = int.from_bytes(data[at : at + 2], "big")
            _need(n >= 2 and at + n <= len(data), "segment cut short")
            body, at = data[at + 2 : at + n], at + n
            if marker == 0xC0:
                _need(not frame.components, "two frame headers")
                frame.height, frame.width, frame.components = _frame_header(body)
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                tables.update(_huffman_tables(body))
            elif marker == 0xDB:
                frame.quantisers.update(_quantisers(body))
            elif marker == 0xDD:
                _need(len(body) == 2, "bad restart interval")
                interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                _need(len(body) >= 1 and len(body) == 4 + 2 * body[0] and body[0] > 0, "bad scan header")
                used = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
                known = {c[0] for c in frame.components}
                _need(len({u[0] for u in used}) == len(used) and all(u[0] in known for u in used), "a scan of other components than the frame's")
                _need(all(t in tables for _, s in used for t in (s >> 4, 0x10 | s & 15)), "a scan without its tables")
                end = _scan_end(data, at)
                frame.scans.append((used, {t: tables[t] for _, s in used for t in (s >> 4, 0x10 | s & 15)}, interval, at, end))
                at = end
        _need(bool(frame.components) and bool(frame.scans), "no frame or scan")
        _need(frame.components[0][3] in frame.quantisers, "no quantiser")
        frames.append(frame)
    _need(bool(frames), "empty")
    return frames


_lookups: dict[tuple, np.ndarray] = {}


def _lookup(table: tuple) -> np.ndarray:
    """For each 16 bits ahead: bits of the code there * 256 + symbol; 0 where no code fits."""
    if table not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        out = np.zeros(65536, dtype=np.int32)
        for code, bits, symbol in codes(list(table[0]), list(table[1])):
            out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits * 256 + symbol
        _lookups[table] = out
    return _lookups[table]


def decode_dc(jobs: list[tuple[bytes, Frame, tuple]]) -> list[dict[int, np.ndarray]]:
    """The DC coefficients of scans of one layout (components, sampling, tables, interval): for each scan, component id -> blocks in coding order.

    All restart intervals of all scans are lanes; every step decodes one Huffman symbol in each lane.
    """
    used, tables, interval, _, _ = jobs[0][2]
    sampling = {c: (h, v) for c, h, v, _ in jobs[0][1].components}
    if len(used) == 1:
        pattern, mcu = [used[0]], None
    else:
        pattern = [u for u in used for _ in range(sampling[u[0]][0] * sampling[u[0]][1])]
        mcu = (max(h for h, _ in sampling.values()), max(v for _, v in sampling.values()))
    datas, lanes, counts = [], [], []
    total = 0
    for data, frame, scan in jobs:
        h, v = mcu or (1, 1)
        if mcu is None:
            ch, cv = sampling[used[0][0]]
            mh, mv = max(x for x, _ in sampling.values()), max(x for _, x in sampling.values())
            units = -(-(-(-frame.width * ch // mh)) // 8) * -(-(-(-frame.height * cv // mv)) // 8)
        else:
            units = -(-frame.width // (8 * h)) * -(-frame.height // (8 * v))
        raw = np.frombuffer(data, dtype=np.uint8, count=scan[4] - scan[3], offset=scan[3]) if scan[4] > scan[3] else np.empty(0, np.uint8)
        ff = np.flatnonzero(raw[:-1] == 255) if len(raw) else np.empty(0, np.int64)
        after = raw[ff + 1]
        gone = np.concatenate([ff[after == 0] + 1, ff[after != 0], ff[after != 0] + 1])
        restarts = np.sort(ff[after != 0])
        keep = np.ones(len(raw), dtype=bool)
        keep[gone[gone < len(raw)]] = False
        # A block takes two bits at least: a file too short for its declared size is refused before anything is set aside for it.
        if units * len(pattern) > 4 * len(raw):
            raise ValueError("scan data end too early")
        starts = np.concatenate([[0], restarts - np.searchsorted(np.sort(gone), restarts)])
        datas.append(raw[keep])
        sizes = [min(interval, units - i) for i in range(0, units, interval)] if interval else [units]
        if len(starts) != len(sizes):
            raise ValueError("restart markers do not fit the frame")
        lanes.append(starts + total)
        counts.append(sizes)
        total += len(datas[-1])
    # Behind the data there is room for what a block can read before its end is checked: 64 codes of at most 16 + 15 bits.
    stream = np.concatenate([*datas, np.full(512, 255, np.uint8)]).astype(np.uint32)
    window = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]
    position = np.concatenate(lanes).astype(np.int64) * 8
    left = np.concatenate([np.array(s) for s in counts]) * len(pattern)
    base = np.zeros(len(left) + 1, dtype=np.int64)
    np.cumsum(left, out=base[1:])
    dc = np.zeros(base[-1], dtype=np.int32)
    ids = [u[0] for u in pattern]
    looks = {t: _lookup(tables[t]) for _, s in pattern for t in (s >> 4, 0x10 | s & 15)}
    done = np.zeros(len(left), dtype=np.int64)
    predicted = {c: np.zeros(len(left), dtype=np.int32) for c in ids}
    live = np.arange(len(left))
    ends = np.append(position[1:], total * 8)  # a lane ends where the next begins

    def symbols(look: np.ndarray, of: np.ndarray) -> np.ndarray:
        p = position[of]
        entry = look[(window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF]
        if not entry.all():
            raise ValueError("no such Huffman code")
        position[of] = p + (entry >> 8)
        return entry & 255

    # Lanes pass blocks in step: all live lanes are at the same block of the pattern.
    block = 0
    while len(live):
        component, selector = pattern[block % len(pattern)]
        size = symbols(looks[selector >> 4], live).astype(np.uint32)
        if size.max() > 11:
            raise ValueError("no such DC category")
        p = position[live]
        # up to 11 bits after up to 7: they are within the 32 ahead
        extra = ((window[p >> 3] << (p & 7).astype(np.uint32)) >> (31 - size) >> 1).astype(np.int32)
        position[live] = p + size
        s = size.astype(np.int32)
        diff = np.where((s > 0) & (extra < (1 << s >> 1)), extra - (1 << s) + 1, extra)
        predicted[component][live] += diff
        dc[base[live] + done[live]] = predicted[component][live]
        done[live] += 1
        look, of = looks[0x10 | selector & 15], live
        k = np.ones(len(of), dtype=np.int64)
        while len(of):
            symbol = symbols(look, of)
            position[of] += symbol & 15
            k = np.where(symbol == 0, 64, k + (symbol >> 4) + 1)
            more = k < 64
            of, k = of[more], k[more]
        if (position[live] > ends[live]).any():
            raise ValueError("scan data end too early")
        block += 1
        live = live[done[live] < left[live]]
    out, lane = [], 0
    which = np.array(ids)
    for sizes in counts:
        own = dc[base[lane] : base[lane + len(sizes)]].reshape(-1, len(pattern))
        out.append({c: own[:, which == c] for c in dict.fromkeys(ids)})
        lane += len(sizes)
    return out


@dataclass
class Thumbnail:
    """A frame's size in pixels, and of each 8x8 block of its luminance the quantised DC term and the mean grey level (0 to 255)."""

    width: int
    height: int
    blocks: np.ndarray
    grey: np.ndarray


_BROKEN = (ValueError, IndexError, KeyError, ZeroDivisionError, OverflowError, MemoryError, TypeError)


def _layout(frame: Frame) -> tuple[tuple, tuple]:
    """The scan with the luminance, and what scans must have in common to be decoded side by side."""
    luminance = frame.components[0][0]
    scan = next((s for s in frame.scans if luminance in [u[0] for u in s[0]]), None)
    if scan is None:
        raise ValueError("no scan of the luminance")
    return scan, (tuple(scan[0]), tuple(sorted(scan[1].items())), scan[2], tuple(c[:3] for c in frame.components))


def _thumbnail(frame: Frame, scan: tuple, blocks: dict[int, np.ndarray]) -> Thumbnail:
    luminance, h, v, quantiser = frame.components[0]
    mh, mv = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    own, wide, high = blocks[luminance], -(-frame.width * h // mh), -(-frame.height * v // mv)
    if len(scan[0]) == 1:
        grid = own.reshape(-1, -(-wide // 8))
    else:
        across = -(-frame.width // (8 * mh))
        grid = own.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
    grid = grid[: -(-high // 8), : -(-wide // 8)]  # blocks that only fill up the last unit are none of the picture
    return Thumbnail(frame.width, frame.height, grid, np.clip(grid * frame.quantisers[quantiser] / 8 + 128, 0, 255))


def thumbnails(media: list[bytes]) -> list[list[Thumbnail] | str]:
    """Each file's frames as thumbnails, or what is wrong with it."""
    out: list = [None] * len(media)
    jobs: dict[tuple, list] = {}
    for i, data in enumerate(media):
        try:
            frames = parse_frames(data)
            out[i] = [None] * len(frames)
            for k, f in enumerate(frames):
                scan, layout = _layout(f)
                jobs.setdefault(layout, []).append((i, k, f, scan))
        except _BROKEN as e:
            out[i] = str(e) or "cut short"
    for work in jobs.values():
        try:
            found = decode_dc([(media[i], f, s) for i, _, f, s in work])
        except _BROKEN:  # one broken file must not spoil its neighbours
            found = []
            for i, _, f, s in work:
                try:
                    found += decode_dc([(media[i], f, s)])
                except _BROKEN as e:
                    found.append(str(e) or "cut short")
        for (i, k, f, scan), blocks in zip(work, found, strict=True):
            if isinstance(out[i], str):
                continue
            try:
                out[i] = blocks if isinstance(blocks, str) else out[i]
                if not isinstance(blocks, str):
                    out[i][k] = _thumbnail(f, scan, blocks)
            except _BROKEN as e:
                out[i] = str(e) or "cut short"
    return out


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8x9 area means is above its right neighbour."""
    image = np.repeat(image, -(-8 // image.shape[0]), axis=0)
    image = np.repeat(image, -(-9 // image.shape[1]), axis=1)
    rows = np.arange(9) * image.shape[0] // 8
    columns = np.arange(10) * image.shape[1] // 9
    sums = np.add.reduceat(np.add.reduceat(image, rows[:-1], axis=0), columns[:-1], axis=1)
    means = sums / np.outer(np.diff(rows), np.diff(columns))
    return np.packbits(means[:, :-1] > means[:, 1:]).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's padded payload as baseline JPEG. Null texts count as empty; equal texts give equal files."""

    def work(part: pa.Table) -> dict[str, list]:
        pairs = [padded(t) for t in part["text"].to_pylist()]
        return {"doc_id": part["doc_id"].to_pylist(), "n_bytes": [n for n, _ in pairs], "media": write_jpegs([p for _, p in pairs])}

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, n_bytes long, media binary", work)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, frames int, error string"


def features(media: DataFrame) -> DataFrame:
    """Reads stored files back: dimensions, thumbnail hash, and the payload that the DC terms hold.

    ``feature`` is "<width>x<height>:<hash of the thumbnail>", of all frames one below the other if they are equally
    wide, else of the first. A null, broken or foreign file gives nulls and ``error``.
    """

    def work(part: pa.Table) -> dict[str, list]:
        files = [m or b"" for m in part["media"].to_pylist()]
        out: dict[str, list] = {x.split()[0]: [] for x in FEATURES.split(", ")}
        for i, n, m, found in zip(part["doc_id"].to_pylist(), part["n_bytes"].to_pylist(), files, thumbnails(files), strict=True):
            row: dict = {"doc_id": i, "n_bytes": n, "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest()}
            if isinstance(found, str):
                row["error"] = found
            else:
                payload = b"".join((t.blocks + 128).clip(0, 255).astype(np.uint8).tobytes() for t in found)
                same = all(t.grey.shape[1] == found[0].grey.shape[1] and t.width == found[0].width for t in found)
                width, height = found[0].width, sum(t.height for t in found) if same else found[0].height
                image = np.concatenate([t.grey for t in found]) if same else found[0].grey
                row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "feature": f"{width}x{height}:{difference_hash(image)}", "width": width, "height": height, "frames": len(found)}
            for name, values in out.items():
                values.append(row.get(name))
        return out

    return map_texts(media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), F.col("media").cast("binary")), FEATURES, work, text="media")
