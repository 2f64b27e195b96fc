"""AVI motion-JPEG: bytes as intra frames in a RIFF file, read back by its index, and shots by histograms.

Each payload byte is the grey level of one 8 by 8 block: a JPEG block with a DC coefficient only and a
quantiser of 8 decodes exactly to it. A frame holds 192 blocks, 16 wide and 12 high, coded with the standard
luminance table for DC and a table of one code, the end of a block, for AC. Frames that others made (baseline, Huffman
coded) are read as well: to the mean grey level of each luminance block."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import map_rows, release, text_of

UNIT = 192
BLOCKS_WIDE, BLOCKS_HIGH = 16, 12
FRAMES_PER_S = 25
#: Payload bytes that are coded at once.
CHUNK = 1 << 20
BINS = 16
#: A cut is where the difference of two frames' histograms exceeds the mean of the LOOK_BACK differences before it by
#: SPREAD deviations and LEAST of the frame's blocks.
LOOK_BACK, SPREAD, LEAST = 8, 3.0, 0.1

# Code lengths and symbols of the standard luminance Huffman tables (DC, AC).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The AC table of these files has one code, of one bit: end of block.
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by category, in canonical order."""
    codes, lengths, code, at = [], [], 0, 0
    for n, count in enumerate(DC_COUNTS, 1):
        for _ in range(count):
            codes.append(code)
            lengths.append(n)
            code += 1
            at += 1
        code <<= 1
    return np.array(codes, np.int64), np.array(lengths, np.int64)


CODES, LENGTHS = _dc_codes()


def jpeg_header() -> bytes:
    quantiser = struct.pack(">HHB", 0xFFDB, 67, 0) + bytes([8] + [1] * 63)
    frame = struct.pack(">HHBHHB", 0xFFC0, 11, 8, BLOCKS_HIGH * 8, BLOCKS_WIDE * 8, 1) + bytes([1, 0x11, 0])
    tables = b"".join(struct.pack(">HHB", 0xFFC4, 19 + len(s), c) + bytes(n) + bytes(s) for c, n, s in ((0x00, DC_COUNTS, DC_SYMBOLS), (0x10, AC_COUNTS, AC_SYMBOLS)))
    scan = struct.pack(">HHB", 0xFFDA, 8, 1) + bytes([1, 0x00, 0, 63, 0])
    return b"\xff\xd8" + quantiser + frame + tables + scan


HEADER, END = jpeg_header(), b"\xff\xd9"


def encode_frames(levels: np.ndarray) -> list[bytes]:
    """JPEG files of frames (n, 192) of grey levels."""
    n = len(levels)
    dc = levels.astype(np.int64) - 128
    step = np.diff(dc, axis=1, prepend=0)
    size = np.abs(step)
    category = np.zeros_like(step)
    for k in range(9):
        category += size >= 1 << k
    low = np.where(step < 0, step + (1 << category) - 1, step)
    bits = LENGTHS[category] + category + 1
    value = ((CODES[category] << category) | low) << 1  # then a 0: end of block
    ends = np.cumsum(bits, axis=1)
    total = (ends[:, -1] + 7) // 8
    first = np.r_[0, np.cumsum(total)]
    begin = ends - bits + (first[:-1] * 8)[:, None]
    at, shift = (begin >> 3).ravel(), (32 - bits - (begin & 7)).ravel()
    word = value.ravel() << shift
    out = np.zeros(int(first[-1]) + 4, np.int64)
    for k in range(4):  # no two codes share a bit, so sums are unions
        part = np.bincount(at + k, (word >> (24 - 8 * k)) & 255, len(out))
        out += part.astype(np.int64)
    pad = total * 8 - ends[:, -1]
    out[first[1:] - 1] |= (1 << pad) - 1
    raw = out[: int(first[-1])].astype(np.uint8)
    marks = np.flatnonzero(raw == 255)
    stuffed = np.insert(raw, marks + 1, 0).tobytes()
    first = first + np.searchsorted(marks, first)
    return [HEADER + stuffed[a:b] + END for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """Category and code length by the next nine bits."""
    category, length = np.full(512, -1, np.int64), np.zeros(512, np.int64)
    for c, (code, n) in enumerate(zip(CODES.tolist(), LENGTHS.tolist())):
        category[code << (9 - n) : (code + 1) << (9 - n)] = c
        length[code << (9 - n) : (code + 1) << (9 - n)] = n
    return category, length


CATEGORY, LENGTH = _lookup()


def segments(frame: bytes) -> tuple[dict[int, list[bytes]], bytes]:
    """The header segments of a JPEG frame by marker, and its entropy-coded data without stuffed zeros (restart marks are left in
    as 0xFFD0 to 0xFFD7)."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    found: dict[int, list[bytes]] = {}
    at = 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        if frame[at] != 0xFF or size < 2:
            raise ValueError("a broken segment")
        found.setdefault(marker, []).append(frame[at + 4 : at + 2 + size])
        at += 2 + size
        if marker == 0xDA:
            end = frame.rfind(b"\xff\xd9")
            return found, frame[at : end if end > at else len(frame)]
    raise ValueError("no scan")


def _huffman(bodies: list[bytes]) -> dict[int, dict[tuple[int, int], int]]:
    """Per table (class and number) the symbol of each (length, code)."""
    out: dict[int, dict[tuple[int, int], int]] = {}
    for body in bodies:
        at = 0
        while at + 17 <= len(body):
            counts, table, code = body[at + 1 : at + 17], {}, 0
            symbols = iter(body[at + 17 : at + 17 + sum(counts)])
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    table[n, code] = next(symbols)
                    code += 1
                code <<= 1
            out[body[at]] = table
            at += 17 + sum(counts)
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.left = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            if self.at >= len(self.data):
                raise ValueError("a frame ends early")
            byte = self.data[self.at]
            self.at += 2 if byte == 0xFF else 1  # the zero after it is stuffed
            self.value, self.left = (self.value << 8 | byte) & (1 << 40) - 1, self.left + 8
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def restart(self) -> None:
        self.left = 0
        self.at += 2


def block_levels(frame: bytes) -> np.ndarray:
    """Mean grey levels (rows, columns) of the luminance blocks of a baseline frame, from their DC coefficients."""
    head, data = segments(frame)
    if 0xC0 not in head and 0xC1 not in head:
        raise ValueError("not a baseline frame")
    own = (head.get(0xC0) or head[0xC1])[0]
    high, wide = struct.unpack(">HH", own[1:5])
    parts = {own[6 + 3 * i]: (own[7 + 3 * i] >> 4, own[7 + 3 * i] & 15, own[8 + 3 * i]) for i in range(own[5])}
    scale = {}
    for body in head.get(0xDB, []):
        at = 0
        while at < len(body):
            two = body[at] >> 4
            scale[body[at] & 15] = int.from_bytes(body[at + 1 : at + 2 + two], "big")
            at += 65 + 64 * two
    tables, scan = _huffman(head.get(0xC4, [])), head[0xDA][0]
    order = [(scan[1 + 2 * i], scan[2 + 2 * i] >> 4, 16 | scan[2 + 2 * i] & 15) for i in range(scan[0])]
    widest, highest = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
    first = order[0][0]
    if len(order) == 1:  # a scan of one component goes block by block
        parts, widest, highest = {first: (1, 1, parts[first][2])}, 1, 1
    across, down = -(-wide // (8 * widest)), -(-high // (8 * highest))
    h, v, q = parts[first]
    out = np.zeros((down * v, across * h))
    every = int.from_bytes(head[0xDD][0], "big") if 0xDD in head else 0
    bits, dc = _Bits(data), dict.fromkeys(parts, 0)
    for unit in range(across * down):
        if every and unit and unit % every == 0:
            bits.restart()
            dc = dict.fromkeys(parts, 0)
        for name, coarse, fine in order:
            for block in range(parts[name][0] * parts[name][1]):
                n = bits.symbol(tables[coarse])
                step = bits.take(n)
                dc[name] += step if not n or step >> (n - 1) else step - (1 << n) + 1
                if name == first:
                    out[unit // across * v + block // h, unit % across * h + block % h] = dc[name]
                at = 1
                while at < 64:  # AC coefficients are passed over
                    symbol = bits.symbol(tables[fine])
                    if symbol & 15:
                        bits.take(symbol & 15)
                    elif symbol != 0xF0:
                        break
                    at += (symbol >> 4) + 1
    return np.clip(np.round(out * scale[q] / 8) + 128, 0, 255).astype(np.uint8)[: -(-high // 8), : -(-wide // 8)]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Grey levels (n, blocks) of a list of frames, one for each luminance block. Frames as encode_frames makes them go forward
    together, one block at a time; others are read one by one (all of a list must have one size). Raises ValueError on what
    is no baseline frame."""
    if any(f[: len(HEADER)] != HEADER or f[-2:] != END for f in frames):
        return np.stack([block_levels(f).ravel() for f in frames])
    head = len(HEADER)
    scans = [f[head:-2] for f in frames]
    lengths = np.array([len(s) for s in scans], np.int64)
    raw = np.frombuffer(b"".join(scans), np.uint8)
    stuffed = np.r_[False, (raw[1:] == 0) & (raw[:-1] == 255)] if len(raw) else np.zeros(0, bool)
    gone = np.r_[0, np.cumsum(stuffed)]
    first = np.r_[0, np.cumsum(lengths)]
    first = first - gone[first]
    data = np.r_[raw[~stuffed], np.zeros(4, np.uint8)].astype(np.int64)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = first[:-1] * 8
    dc = np.zeros(len(frames), np.int64)
    out = np.empty((len(frames), UNIT), np.uint8)
    for k in range(UNIT):
        bits = window[at >> 3] << (at & 7) & 0xFFFFFFFF
        category, used = CATEGORY[bits >> 23], LENGTH[bits >> 23]
        value = (bits >> (32 - used - category)) & ((1 << category) - 1)
        dc += np.where(value < (1 << category) >> 1, value - (1 << category) + 1, value)
        out[:, k] = dc + 128
        at += used + category + 1
    if len(frames) and (at > first[1:] * 8).any():
        raise ValueError("a frame ends early")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """A RIFF file of one video stream with its index."""
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FRAMES_PER_S, largest * FRAMES_PER_S, 0, 0x10, len(frames), 0, 1, largest, BLOCKS_WIDE * 8, BLOCKS_HIGH * 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiIhhhh", 0, 0, 0, 0, 1, FRAMES_PER_S, 0, len(frames), largest, -1, 0, 0, 0, BLOCKS_WIDE * 8, BLOCKS_HIGH * 8)
    picture = struct.pack("<IiiHH4sIiiII", 40, BLOCKS_WIDE * 8, BLOCKS_HIGH * 8, 1, 24, b"MJPG", BLOCKS_WIDE * BLOCKS_HIGH * 192, 0, 0, 0, 0)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    size = np.array([len(f) for f in frames], np.int64)
    place = 4 + np.r_[0, np.cumsum(8 + size + (size & 1))[:-1]]
    entries = np.empty((len(frames), 4), "<u4")
    entries[:, 0] = int.from_bytes(b"00dc", "little")
    entries[:, 1] = 0x10
    entries[:, 2], entries[:, 3] = place, size
    movie = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", f) for f in frames]))
    body = b"AVI " + headers + movie + _chunk(b"idx1", entries.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> list[bytes]:
    """The frames of a RIFF file, found by its index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, index = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movie is None or index is None:
        raise ValueError("no frames or no index")
    own = index[index[:, 0] == int.from_bytes(b"00dc", "little")]
    return [data[movie + p + 8 : movie + p + 8 + n] for p, n in own[:, 2:].tolist()]


def shots(levels: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end) of each shot of frames (n, blocks), by adaptive histogram differences."""
    n, blocks = levels.shape
    counts = np.bincount((np.arange(n)[:, None] * BINS + (levels >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    jump = np.abs(np.diff(counts, axis=0)).sum(axis=1) / (2 * blocks)
    sums, squares = np.r_[0, np.cumsum(jump)], np.r_[0, np.cumsum(jump * jump)]
    here = np.arange(len(jump))
    since = np.maximum(here - LOOK_BACK, 0)
    seen = here - since
    mean = (sums[here] - sums[since]) / np.maximum(seen, 1)
    spread = np.sqrt(np.maximum((squares[here] - squares[since]) / np.maximum(seen, 1) - mean * mean, 0))
    cuts = (np.flatnonzero((seen >= 2) & (jump > mean + SPREAD * spread) & (jump - mean > LEAST)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n]))


def payload(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def stored(texts: list[str]):
    """(length, AVI file, levels read back from it) of each text."""
    own = [payload(t) for t in texts]
    levels = np.frombuffer(b"".join(p for p, _ in own), np.uint8).reshape(-1, UNIT)
    ends = np.cumsum([len(p) // UNIT for p, _ in own]).tolist()
    frames = encode_frames(levels)
    files = [write_avi(frames[a:b]) for a, b in zip([0, *ends], ends)]
    back = decode_frames([f for data in files for f in read_avi(data)])
    return [(n, data, back[a:b]) for (_, n), data, a, b in zip(own, files, [0, *ends], ends)]


def _chunks(batches):
    """(doc_ids, texts) of about CHUNK characters together."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): each text as an AVI file."""

    def work(batches):
        for ids, texts in _chunks(batches):
            yield pd.DataFrame({"doc_id": ids, "media": [data for _, data, _ in stored(texts)]})
        release()

    return map_rows(docs.select("doc_id", text_of().alias("text")), work, "media binary")


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of rows (doc_id, media): doc_id, clip, first_frame, end_frame, start_s, end_s."""

    def work(batches):
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch["doc_id"].tolist(), batch["media"]):
                for k, (a, b) in enumerate(shots(decode_frames(read_avi(bytes(data))))):
                    rows.append((doc_id, k, a, b, a / FRAMES_PER_S, b / FRAMES_PER_S))
            yield pd.DataFrame(rows, columns=["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s"])

    return map_rows(media.select("doc_id", "media"), work, "clip int, first_frame int, end_frame int, start_s double, end_s double")


def media_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    feature: frames, clips, seconds and the first frame of each clip. A null text counts as empty: one
    frame of spaces. Equal texts have equal values; repeated rows repeat; an empty table gives no
    rows."""

    def work(batches):
        for ids, texts in _chunks(batches):
            rows = []
            for doc_id, (n, data, levels) in zip(ids, stored(texts)):
                raw, found = levels.tobytes(), shots(levels)
                feature = f"frames={len(levels)};clips={len(found)};seconds={len(levels) / FRAMES_PER_S:.2f};starts={','.join(str(a) for a, _ in found)}"
                rows.append((doc_id, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    columns = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(docs.select("doc_id", text_of().alias("text")), work, columns)
