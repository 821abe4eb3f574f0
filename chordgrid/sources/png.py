"""PNG files as arrays: chunks with checksums, rows unfiltered by numpy, all colour kinds and depths, interlaced or not."""

from __future__ import annotations

import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Fixed values of the format: samples of each colour kind, and where the seven passes of an interlaced image begin and step.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _chunks(data: bytes):
    """(kind, content) of each chunk up to the last; raises ValueError for anything broken."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        body = data[at + 4 : at + 8 + size]
        if len(body) != size + 4 or zlib.crc32(body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk is cut off or its checksum is wrong")
        yield body[:4], body[4:]
        if body[:4] == b"IEND":
            return
        at += 12 + size
    raise ValueError("the end is missing")


def _unfiltered(raw: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """(rows, width) bytes from lines of a filter's number and filtered bytes; ``step`` bytes lie between a byte and its left one."""
    lines = raw.reshape(rows, width + 1)
    out = np.zeros((rows + 1, width), np.uint8)
    for y in range(rows):
        kind, line, above, own = int(lines[y, 0]), lines[y, 1:], out[y], out[y + 1]
        if kind == 0:
            own[:] = line
        elif kind == 1:
            for lane in range(step):
                own[lane::step] = np.cumsum(line[lane::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            own[:] = line + above
        elif kind in (3, 4):
            for lane in range(step):
                left = corner = 0
                done = bytearray()
                for value, up in zip(line[lane::step].tolist(), above[lane::step].tolist()):
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                        guess = left if to_left <= to_up and to_left <= to_corner else up if to_up <= to_corner else corner
                    left, corner = (value + guess) & 255, up
                    done.append(left)
                own[lane::step] = np.frombuffer(done, np.uint8)
        else:
            raise ValueError(f"no filter has the number {kind}")
    return out[1:]


def _samples(lines: np.ndarray, width: int, count: int, depth: int) -> np.ndarray:
    """(rows, width, count) samples of lines of bytes."""
    if depth == 16:
        return lines.reshape(len(lines), width, count, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)[:, : width * count]
        lines = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
    return lines.reshape(len(lines), width, count)


def decoded(data: bytes) -> np.ndarray:
    """(h, w, c) of 8-bit samples; lesser depths are spread over 0 to 255, of 16 bits the upper eight stay, palettes become colours."""
    kinds: dict[bytes, list[bytes]] = {}
    for kind, content in _chunks(data):
        kinds.setdefault(kind, []).append(content)
    head = kinds.get(b"IHDR", [b""])[0]
    if len(head) != 13 or b"IDAT" not in kinds:
        raise ValueError("header or data are missing")
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, _, _, interlaced = head[8:]
    if colour not in _SAMPLES or depth not in (1, 2, 4, 8, 16) or not width or not height:
        raise ValueError("a header that no PNG file has")
    count = _SAMPLES[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(kinds[b"IDAT"])), np.uint8)
    except zlib.error as error:
        raise ValueError("the data can't be unpacked") from error
    image = np.zeros((height, width, count), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for top, left, down, right in _PASSES if interlaced else ((0, 0, 1, 1),):
        rows, columns = -(-(height - top) // down), -(-(width - left) // right)
        if rows <= 0 or columns <= 0:
            continue
        size = -(-columns * count * depth // 8)
        part = raw[at : at + rows * (size + 1)]
        if len(part) != rows * (size + 1):
            raise ValueError("the data are too short")
        at += len(part)
        image[top::down, left::right] = _samples(_unfiltered(part, rows, size, max(1, count * depth // 8)), columns, count, depth)
    if colour == 3:
        palette = np.frombuffer(kinds.get(b"PLTE", [b""])[0], np.uint8).reshape(-1, 3)
        if image.max() >= len(palette):
            raise ValueError("a colour is not in the palette")
        return palette[image[:, :, 0]]
    if depth == 16:
        return (image >> 8).astype(np.uint8)
    return image if depth == 8 else image * np.uint8(255 // ((1 << depth) - 1))
