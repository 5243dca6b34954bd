"""Image embeddings: an interface for models, run where the images are."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType


class Embedder(ABC):
    """One vector an image. ``device`` is where the model runs; ``setup`` makes it, once a task."""

    def __init__(self, device: str = "cpu") -> None:
        self.device = device

    def to(self, device: str) -> Embedder:
        self.device = device
        return self

    def setup(self) -> None:
        """Load the model on the worker."""

    @abstractmethod
    def embed_image(self, image: np.ndarray) -> np.ndarray:
        """The vector of height x width x 3 pixels."""

    def embed_batch(self, images: np.ndarray) -> np.ndarray:
        """A vector for each of images x height x width x 3 pixels; models that take many at once have their own."""
        return np.stack([self.embed_image(x) for x in images])


def to_batch(image: np.ndarray) -> np.ndarray:
    """Pixels as 1 x 3 x height x width 32-bit floats from 0 to 1; batches of images keep their number."""
    if not isinstance(image, np.ndarray):
        raise ValueError("an image is an array")
    x = image.astype(np.float32) / np.float32(255)
    if x.ndim == 3:
        x = x[None]
    if x.ndim != 4:
        raise ValueError("an image has three dimensions, a batch four")
    return x.transpose(0, 3, 1, 2)


class MeanColour(Embedder):
    """Mean of each channel over a grid of ``cells`` x ``cells``: the same on every run."""

    def __init__(self, cells: int = 2, device: str = "cpu") -> None:
        super().__init__(device)
        self.cells = cells

    def embed_image(self, image: np.ndarray) -> np.ndarray:
        x = to_batch(image)[0]
        rows = np.array_split(np.arange(x.shape[1]), self.cells)
        columns = np.array_split(np.arange(x.shape[2]), self.cells)
        return np.array([x[:, r][:, :, c].mean(axis=(1, 2)) if len(r) and len(c) else np.zeros(len(x)) for r in rows for c in columns], np.float32).reshape(-1)


class NetVlad(Embedder):
    """A NetVLAD model, where torch and hloc are installed."""

    def __init__(self, conf: dict | None = None, device: str = "cuda:0") -> None:
        super().__init__(device)
        self.conf = conf or {}

    def setup(self) -> None:
        try:
            import torch
            from hloc.extractors.netvlad import NetVLAD
        except ImportError as e:
            raise RuntimeError("this embedder needs torch and hloc") from e
        self.torch, self.model = torch, NetVLAD(self.conf).eval().to(self.device)

    def embed_image(self, image: np.ndarray) -> np.ndarray:
        return self.embed_batch(image[None])[0]

    def embed_batch(self, images: np.ndarray) -> np.ndarray:
        with self.torch.no_grad():
            found = self.model({"image": self.torch.from_numpy(to_batch(images)).to(self.device)})
        return found["global_descriptor"].cpu().numpy().reshape(len(images), -1)


#: Pixels' bytes, and images, that a model gets at once.
BATCH_BYTES, BATCH_IMAGES = 1 << 25, 64
#: The models that a worker process has set up, by what they were before.
_models: dict[bytes, Embedder] = {}


def _set_up(pickled: bytes) -> Embedder:
    """The worker's own model; its tasks share it."""
    if pickled not in _models:
        model = cloudpickle.loads(pickled)
        model.setup()
        _models.clear()  # one at a time
        _models[pickled] = model
    return _models[pickled]


def packed(images: Iterator[tuple], size: int, most: int) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """((height, width), [(name, pixels), ...]) of images (name, height, width, pixels): images of a shape together, up to ``size`` bytes and
    ``most`` images. Of all shapes together no more than ``size`` bytes wait; an image that is larger goes alone."""
    waiting: dict[tuple[int, int], list[tuple]] = {}
    held = 0
    for name, height, width, data in images:
        own = waiting.setdefault((height, width), [])
        if own and (len(own) + 1) * len(data) > size:
            held -= len(own) * len(data)
            yield (height, width), waiting.pop((height, width))
            own = waiting.setdefault((height, width), [])
        own.append((name, data))
        held += len(data)
        if len(own) >= most:
            held -= len(own) * len(data)
            yield (height, width), waiting.pop((height, width))
        while held > size and len(waiting) > 1:  # the shape that holds most makes room
            shape = max(waiting, key=lambda s: len(waiting[s]) * s[0] * s[1])
            held -= sum(len(d) for _, d in waiting[shape])
            yield shape, waiting.pop(shape)
    yield from waiting.items()


def extract_embeddings(images: DataFrame, embedder: Embedder, size: int = 0, most: int = 0) -> DataFrame:
    """(origin, embedding, error) of images (origin, height, width, data: rows of RGB), in batches of one shape of at most ``size`` bytes and
    ``most`` images (by default ``BATCH_BYTES`` and ``BATCH_IMAGES``). A worker process sets the model up once.

    Where a batch fails its images are tried one by one, and those that fail have no embedding, but what was wrong. Null or empty
    pixels, and such as don't fit height and width, are errors too.
    """
    pickled, size, most = cloudpickle.dumps(embedder), size or BATCH_BYTES, most or BATCH_IMAGES
    schema = pa.schema([("origin", pa.string()), ("embedding", pa.list_(pa.float32())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: list[tuple] = []

        def good() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    name, height, width, data = (c[k].as_py() for c in batch.columns)  # copies: what waits must not hold its whole batch
                    if data is None or not height or not width or height < 0 or len(data) != height * width * 3:
                        bad.append((name, None, f"{None if data is None else len(data)} bytes for {height} x {width} pixels"))
                    else:
                        yield name, height, width, data

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        model = None
        for (height, width), group in packed(good(), size, most):
            model = model or _set_up(pickled)
            pixels = np.stack([np.frombuffer(d, np.uint8).reshape(height, width, 3) for _, d in group])
            try:
                found = [(name, vector, None) for (name, _), vector in zip(group, np.asarray(model.embed_batch(pixels), np.float32), strict=True)]
            except Exception:
                found = []
                for (name, _), image in zip(group, pixels, strict=True):
                    try:
                        found.append((name, np.asarray(model.embed_image(image), np.float32), None))
                    except Exception as e:
                        found.append((name, None, f"{type(e).__name__}: {e}"))
            yield rows(found + bad)
            bad.clear()
        if bad:
            yield rows(bad)

    return images.select("origin", "height", "width", "data").mapInArrow(run, "origin string, embedding array<float>, error string")


def scaled_pixels(values: Column) -> Column:
    """Pixel values from 0 to 1."""
    return F.transform(values, lambda v: v / F.lit(255.0))


def batches(images: DataFrame, id_col: str = "origin") -> DataFrame:
    """(id, shape, pixels) of images (id, height, width, data: rows of RGB): ``to_batch`` of each, flat, in the order of its shape."""
    kind = images.schema[id_col].dataType

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            start, shapes, pixels = 0, [], []
            for k in range(batch.num_rows):
                height, width, data = (batch.column(j)[k].as_py() for j in (1, 2, 3))
                x = to_batch(np.asarray(data, np.uint8).reshape(height, width, 3))
                shapes.append(x.shape)
                pixels.append(x.reshape(-1))
                if k + 1 == batch.num_rows or sum(p.nbytes for p in pixels) > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(pixels)), pa.array(shapes, pa.list_(pa.int32())), pa.array(pixels, pa.list_(pa.float32()))], names=[id_col, "shape", "pixels"])
                    start, shapes, pixels = k + 1, [], []

    schema = StructType([StructField(id_col, kind), StructField("shape", ArrayType(IntegerType())), StructField("pixels", ArrayType(FloatType()))])
    return images.select(id_col, "height", "width", "data").mapInArrow(run, schema)
