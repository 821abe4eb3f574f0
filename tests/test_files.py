"""Image files: PNG against a plain writer, folders of classes, and binary files read by ranges."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from chordgrid.sources import images, png

RNG = np.random.default_rng(11)
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def chunk(kind, content):
    return len(content).to_bytes(4, "big") + kind + content + zlib.crc32(kind + content).to_bytes(4, "big")


def filtered(lines, step):
    """Lines of bytes, each under a filter of its own, the plain way."""
    out = bytearray()
    for y, line in enumerate(lines):
        kind = int(RNG.integers(0, 5))
        out.append(kind)
        for i, value in enumerate(line):
            a = line[i - step] if i >= step else 0
            b = lines[y - 1][i] if y else 0
            c = lines[y - 1][i - step] if y and i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((value - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    return bytes(out)


def written(samples, colour, depth, interlaced=False, palette=b""):
    """A PNG file of (h, w, c) samples."""
    h, w, c = samples.shape
    data = b""
    for top, left, down, right in PASSES if interlaced else [(0, 0, 1, 1)]:
        part = samples[top::down, left::right]
        if not part.size:
            continue
        lines = []
        for row in part:
            bits = "".join(f"{int(v):0{depth}b}" for v in row.ravel())
            bits += "0" * (-len(bits) % 8)
            lines.append([int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)])
        data += filtered(lines, max(1, c * depth // 8))
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([depth, colour, 0, 0, int(interlaced)])
    packed = zlib.compress(data)
    middle = chunk(b"PLTE", palette) if palette else b""
    return png.SIGNATURE + chunk(b"IHDR", head) + middle + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("colour, depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_png(colour, depth, interlaced):
    count = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    for _ in range(6):
        h, w = (int(n) for n in RNG.integers(1, 20, 2))
        samples = RNG.integers(0, 1 << depth, (h, w, count))
        palette = RNG.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
        got = png.decoded(written(samples, colour, depth, interlaced, palette.tobytes() if colour == 3 else b""))
        if colour == 3:
            want = palette[samples[:, :, 0]]
        else:
            want = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
        assert got.dtype == np.uint8 and (got == want).all()


def test_broken_png_files():
    good = written(RNG.integers(0, 256, (5, 7, 3)), 2, 8)
    for broken in (b"", good[:-4], good[:30] + b"\0" + good[31:], b"x" + good[1:], good[:-12]):
        with pytest.raises(ValueError):
            png.decoded(broken)


def test_folders_of_classes(spark, tmp_path):
    root = tmp_path / "tiny-imagenet-200"
    kept = {}
    for half, name, colour in (("train", "n02/images", 2), ("train", "n01/images", 0), ("test", "n01", 6)):
        (root / half / name).mkdir(parents=True)
        for k in range(3):
            samples = RNG.integers(0, 256, (4, 5, {0: 1, 2: 3, 6: 4}[colour]))
            (root / half / name / f"{k}.png").write_bytes(written(samples, colour, 8))
            kept[half, name[:3], k] = np.repeat(samples, 3, 2) if colour == 0 else samples[:, :, :3]
    (root / "train" / "stray.png").write_bytes(b"not in a class")
    got = images.tiny_imagenet(spark, str(tmp_path)).orderBy("imgid").collect()
    assert [(r.imgid, r.label, r.h, r.w, r.c) for r in got] == [(i, i // 3, 4, 5, 3) for i in range(6)]
    for r in got:
        want = kept["train", ("n01", "n02")[r.label], r.imgid % 3].transpose(2, 0, 1).ravel()
        assert (np.rint(np.array(r.data) * 255) == want).all()
    assert [tuple(r) for r in images.class_list(spark, str(root / "train")).orderBy("label").collect()] == [(0, "n01"), (1, "n02")]
    assert images.tiny_imagenet(spark, str(tmp_path), train=False).count() == 3
    assert {(r.c, len(r.data)) for r in images.image_folder(spark, str(root / "test"), channels=1).collect()} == {(1, 20)}


def test_one_binary_file_is_read_by_many_tasks(spark, tmp_path):
    records = RNG.integers(0, 256, (50, 3073)).astype(np.uint8)
    (tmp_path / "data_batch_3.bin").write_bytes(records.tobytes())
    found = images.cifar10(spark, str(tmp_path / "data_batch_3.bin"), split_bytes=20_000)
    assert found.rdd.getNumPartitions() > 5
    for r in found.collect():
        own = records[r.imgid - 30_000]
        assert r.label == own[0] and (np.rint(np.array(r.data) * 255) == own[1:]).all()
    assert found.count() == 50
    (tmp_path / "short.bin").write_bytes(bytes(100))
    with pytest.raises(Exception):
        images.fixed_records(spark, str(tmp_path / "short.bin"), 3073).collect()


@pytest.mark.parametrize("h, w", [(28, 28), (3, 5)])
def test_idx_files(spark, tmp_path, h, w):
    samples, labels = RNG.integers(0, 256, (40, h * w)).astype(np.uint8), RNG.integers(0, 10, 40).astype(np.uint8)
    (tmp_path / "im").write_bytes(b"\0\0\x08\x03" + b"".join(n.to_bytes(4, "big") for n in (40, h, w)) + samples.tobytes())
    (tmp_path / "lb").write_bytes(b"\0\0\x08\x01" + (40).to_bytes(4, "big") + labels.tobytes())
    found = images.mnist(spark, str(tmp_path / "im"), str(tmp_path / "lb"), split_bytes=400).orderBy("imgid").collect()
    assert [r.imgid for r in found] == list(range(40)) and [r.label for r in found] == labels.tolist()
    assert all((np.rint(np.array(r.data) * 255) == samples[r.imgid]).all() and (r.h, r.w, r.c) == (h, w, 1) for r in found)
