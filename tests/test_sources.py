import math
import struct
import sys
import types

import numpy as np
import pytest

from skarn.operators import embed
from skarn.sources import files, hdf5, ranged
from skarn.sources.ranged import Window

from .test_store import png


def jpeg(width, height, before=0, focal=None, pixels=0):
    """A JPEG of which other segments take ``before`` bytes, with so many bytes of pixels."""
    out = b"\xff\xd8"
    while before > 0:
        n = min(before, 65_000)
        out += b"\xff\xe2" + struct.pack(">H", n + 2) + b"\xff" * n
        before -= n
    if focal:
        exif = b"Exif\0\0II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 1) + struct.pack("<HHIHH", 0xA405, 3, 1, focal, 0) + b"\0" * 4
        out += b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif
    return out + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\0" * 9 + b"\xff\xda" + b"\0" * pixels


@pytest.mark.parametrize(("before", "most"), [(0, 1 << 16), (300_000, 1 << 17)])
def test_headers_read_ranges(before, most):
    content = jpeg(640, 480, before, 35, 50_000_000)
    read = []

    def read_at(n, at):
        read.append(n)
        return content[at : at + n]

    assert files.read_header(Window(read_at, len(content))) == (640, 480, 35)
    assert sum(read) <= most
    for cut in (1, 3, 10, 45):
        assert files.image_size(content[:cut]) is None
    assert files.image_size(b"\xff\xd8" + b"\xff" * 100) is None and files.image_size(b"") is None


def test_image_headers_of_huge_files(spark, tmp_path):
    (tmp_path / "a b%20.jpg").write_bytes(jpeg(30, 20, 200_000, 50, 10))
    (tmp_path / "sub").mkdir()
    with open(tmp_path / "sub" / "huge.png", "wb") as f:  # more than a value may hold: only ranges of it can be read
        f.write(png(7, 5, (1, 2, 3)))
        f.truncate(3 << 30)
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "text.txt").write_bytes(b"none")
    got = files.image_headers(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == [("a b%20.jpg", 30, 20, 50), ("sub/huge.png", 7, 5, None)]
    assert got.columns == ["name", "width", "height", "film_focal"]


def test_paths(tmp_path):
    (tmp_path / "x y").write_bytes(b"abc")
    for path in (str(tmp_path / "x y"), f"file:{tmp_path}/x y", f"file://{tmp_path}/x y"):
        with ranged.opened(path) as f:
            assert f.read_at(2, 1) == b"bc"
    assert [ranged.scheme(p) for p in ("/a", "file:/a", "hdfs://h:1/a", "viewfs://s/a")] == ["file", "file", "hdfs", "viewfs"]


@pytest.mark.parametrize(("sizes", "parts"), [([10], 3), ([1000, 1, 1, 0, 5], 8), ([0, 0], 4), ([], 4), ([3, 4, 5], 100), ([2] * 50, 7)])
def test_ranges_cover_each_dataset_once(sizes, parts):
    found = hdf5.ranges(iter(sizes), parts, sum(sizes))
    every = [(g, k) for g, n in enumerate(sizes) for k in range(n)]
    got = []
    for r in found:
        start = every.index((r.group, r.skip)) if r.n else 0
        got += every[start : start + r.n]
    assert got == every and len(found) <= parts and all(r.n <= math.ceil(sum(sizes) / parts) for r in found)


def test_packed_by_shape_and_bytes():
    images = [(k, h, 2, b"\0" * (h * 6)) for k, h in enumerate([1, 2, 1, 1, 50, 2, 1, 1, 1, 3, 3, 1])]
    got = list(embed.packed(iter(images), 36, 3))
    assert sorted(n for _, own in got for n, _ in own) == list(range(12))
    for (h, w), own in got:
        assert len(own) <= 3 and all(len(d) == h * w * 3 for _, d in own) and (len(own) == 1 or len(own) * h * w * 3 <= 36)
    assert max(len(own) for _, own in got) == 3


def test_what_waits_is_bounded():
    rng = np.random.default_rng(4)
    given, taken, most = 0, 0, 0

    def images():
        nonlocal given, most
        for k in range(3000):
            h, w = (int(x) for x in rng.integers(1, 12, 2))
            given += h * w * 3
            most = max(most, given - taken)
            yield k, h, w, bytes(h * w * 3)

    for (h, w), own in embed.packed(images(), 6000, 50):
        taken += len(own) * h * w * 3
    assert given == taken and most <= 6000 + 11 * 11 * 3


class Counting(embed.MeanColour):
    """Tells by its vectors how many images came together, and fails on some."""

    def setup(self):
        self.ready = getattr(self, "ready", 0) + 1

    def embed_batch(self, images):
        assert images.nbytes <= 4000
        if images[:, 0, 0, 0].max() == 255:
            raise RuntimeError("too bright")
        return np.array([[len(images), self.ready]] * len(images))

    def embed_image(self, image):
        return self.embed_batch(image[None])[0]


def test_embeddings_in_batches_with_errors(spark):
    rows = [(f"i{k}", 4, 8, bytes([k % 200] * 96)) for k in range(60)] + [("wide", 2, 100, bytes(600)), ("bright", 4, 8, b"\xff" * 96), ("cut", 4, 8, b"12"), ("none", 4, 8, None), ("flat", 0, 8, b"")]
    images = spark.createDataFrame(rows, "origin string, height int, width int, data binary").coalesce(1)
    got = {r["origin"]: r for r in embed.extract_embeddings(images, Counting(), size=4000, most=16).collect()}
    assert len(got) == len(rows)
    sizes = [got[f"i{k}"]["embedding"][0] for k in range(60)]
    assert max(sizes) == 16 and sizes.count(1.0) < 30 and {got[f"i{k}"]["embedding"][1] for k in range(60)} == {1.0}
    assert got["bright"]["embedding"] is None and "too bright" in got["bright"]["error"] and got["wide"]["embedding"] == [1.0, 1.0]
    assert all(got[n]["embedding"] is None and "bytes for" in got[n]["error"] for n in ("cut", "none", "flat"))
    assert sum(r["error"] is not None for r in got.values()) == 4
    assert embed.extract_embeddings(images.limit(0), Counting()).count() == 0


def test_a_model_that_takes_many_images(monkeypatch):
    import contextlib

    class Vector(np.ndarray):
        to = lambda self, device: self
        cpu = lambda self: self
        numpy = lambda self: np.asarray(self)

    class Model:
        def __init__(self, conf):
            pass

        eval = lambda self: self
        to = lambda self, device: self

        def __call__(self, data):
            assert data["image"].shape == (3, 3, 2, 4) and data["image"].max() <= 1
            return {"global_descriptor": data["image"].mean(axis=(2, 3))}

    torch = types.ModuleType("torch")
    torch.no_grad, torch.from_numpy = contextlib.nullcontext, lambda x: x.view(Vector)
    netvlad = types.ModuleType("hloc.extractors.netvlad")
    netvlad.NetVLAD = Model
    for name, module in {"torch": torch, "hloc": types.ModuleType("hloc"), "hloc.extractors": types.ModuleType("hloc.extractors"), "hloc.extractors.netvlad": netvlad}.items():
        monkeypatch.setitem(sys.modules, name, module)
    model = embed.NetVlad().to("cpu")
    model.setup()
    images = np.stack([np.full((2, 4, 3), v, np.uint8) for v in (0, 51, 255)])
    assert np.allclose(model.embed_batch(images), [[0.0] * 3, [0.2] * 3, [1.0] * 3])
