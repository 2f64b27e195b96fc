"""Motion-JPEG frames against an independent plain decoder, and frames of another encoder."""

import math
import random
import struct

import numpy as np
import pytest

from flowlab.llm import media


def bit_string(data):
    return "".join(f"{b:08b}" for b in data.replace(b"\xff\x00", b"\xff"))


def plain_decode(frame):
    """Pixels of a one-component baseline frame, bit by bit, with the inverse cosine transform written out."""
    at, tables, quant = 2, {}, None
    while True:
        marker, size = struct.unpack(">HH", frame[at : at + 4])
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFFDB:
            quant = list(body[1:65])
        elif marker == 0xFFC0:
            high, wide = struct.unpack(">HH", body[1:5])
        elif marker == 0xFFC4:
            code, symbols, own = 0, list(body[17:]), {}
            for n in range(16):
                for _ in range(body[1 + n]):
                    own[f"{code:0{n + 1}b}"] = symbols.pop(0)
                    code += 1
                code *= 2
            tables[body[0]] = own
        elif marker == 0xFFDA:
            break
    bits = iter(bit_string(frame[at:-2]))

    def symbol(table):
        code = next(bits)
        while code not in table:
            code += next(bits)
        return table[code]

    def number(n):
        raw = "".join(next(bits) for _ in range(n))
        return 0 if not n else int(raw, 2) if raw[0] == "1" else int(raw, 2) - 2**n + 1

    zigzag = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: (sum(p), p[1] if sum(p) % 2 == 0 else p[0]))
    image, dc = np.zeros((high, wide)), 0
    wave = [[(math.sqrt(0.5) if u == 0 else 1) * math.cos((2 * x + 1) * u * math.pi / 16) / 2 for x in range(8)] for u in range(8)]
    for top in range(0, high, 8):
        for left in range(0, wide, 8):
            block = np.zeros((8, 8))
            dc += number(symbol(tables[0]))
            block[0, 0] = dc * quant[0]
            k = 1
            while k < 64:
                s = symbol(tables[16])
                if s == 0:
                    break
                k += s >> 4
                value = number(s & 15)
                block[zigzag[k]] = value * quant[k]
                k += 1
            image[top : top + 8, left : left + 8] = np.array(wave).T @ block @ np.array(wave) + 128
    return image


def test_frames_decode_to_flat_blocks():
    rng = np.random.default_rng(2)
    levels = np.concatenate([rng.integers(0, 256, (4, 192)), np.zeros((1, 192), int), np.full((1, 192), 255), np.tile([0, 255], (1, 96))]).astype(np.uint8)
    frames = media.encode_frames(levels)
    for frame, own in zip(frames, levels):
        image = plain_decode(frame)
        assert image.shape == (96, 128)
        want = np.kron(own.reshape(12, 16), np.ones((8, 8)))
        assert np.abs(image - want).max() < 1e-6
        assert (media.block_levels(frame).ravel() == own).all()
    assert (media.decode_frames(frames) == levels).all()


def other_frame(levels, rng, restart=0):
    """A frame as another encoder may write it: AC coefficients, another quantiser, a comment, two chroma parts at half size."""
    tall, wide = levels.shape
    dc = {n: f"{i:04b}" for i, n in enumerate(range(12))}
    ac = {s: f"{i:04b}" for i, s in enumerate([0x00, 0x01, 0x02, 0x11, 0x23, 0xF0, 0x05])}

    def table(kind, codes):
        return struct.pack(">HHB", 0xFFC4, 19 + len(codes), kind) + bytes([0, 0, 0, len(codes), *[0] * 12]) + bytes(codes)

    def number(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + 2**n - 1:0{n}b}" if n else ""

    out, bits, last = b"", "", [0, 0, 0]
    def close(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    unit = marks = 0
    for top in range(0, tall, 2):
        for left in range(0, wide, 2):
            if restart and unit and unit % restart == 0:
                out += close(bits) + bytes([0xFF, 0xD0 + marks % 8])
                bits, last, marks = "", [0, 0, 0], marks + 1
            unit += 1
            blocks = [(0, int(levels[top + y, left + x]) - 128) for y in (0, 1) for x in (0, 1)] + [(1, rng.randint(-50, 50)), (2, rng.randint(-50, 50))]
            for part, value in blocks:
                n, raw = number(value - last[part])
                last[part] = value
                bits += dc[n] + raw
                for _ in range(rng.randint(0, 3)):
                    s = rng.choice([0x01, 0x02, 0x11, 0x23, 0xF0, 0x05])
                    bits += ac[s] + "".join(rng.choice("01") for _ in range(s & 15))
                bits += ac[0x00]
    out += close(bits)
    head = b"\xff\xd8" + struct.pack(">HH", 0xFFFE, 6) + b"note" + struct.pack(">HHB", 0xFFDB, 67, 0) + bytes([8] + [3] * 63)
    head += struct.pack(">HHBHHB", 0xFFC0, 17, 8, tall * 8, wide * 8, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head += table(0, list(dc)) + table(16, list(ac)) + (struct.pack(">HHH", 0xFFDD, 4, restart) if restart else b"")
    return head + struct.pack(">HHB", 0xFFDA, 12, 3) + bytes([1, 0, 2, 0, 3, 0, 0, 63, 0]) + out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 3])
def test_other_baseline_frames(restart):
    rng = random.Random(1)
    levels = np.random.default_rng(3).integers(0, 256, (6, 8)).astype(np.uint8)
    frames = [other_frame(levels, rng, restart), other_frame(255 - levels, rng, restart)]
    got = media.decode_frames(frames)
    assert (got[0].reshape(6, 8) == levels).all() and (got[1].reshape(6, 8) == 255 - levels).all()


def test_files_that_are_none():
    for data in (b"", b"plain", b"\xff\xd8\xff\xda"):
        with pytest.raises(ValueError):
            media.decode_frames([data])
