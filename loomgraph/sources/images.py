"""Images as binary columns: guarded downloads, thumbnails and feature vectors with pluggable codecs and encoders.

Codecs and encoders are plain functions shipped to the executors, so that a real decoder or a pretrained network can take the place of the built-in ones: binary pixel maps
(P5, P6), area means for resizing, and a 16 x 16 x 3 grid of means (768 numbers) as feature vector. An unreadable image gives no row of features and ok = false as thumbnail.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

GRID = 16


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def download(url: str, get: Callable[[str], tuple[int, bytes]], waits: tuple[float, ...] = (30, 60, 120), sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """Body of a URL; status 429 is tried again after each of the waits, any other failure and the last 429 give None."""
    for wait in (*waits, None):
        status, body = get(url)
        if status == 200:
            return body
        if status != 429 or wait is None:
            return None
        sleep(wait)
    return None


def decode_pixmap(data: bytes) -> np.ndarray:
    """Height x width x 3 array of a binary pixel map (P6 colour, P5 grey)."""
    parts, at = [], 0
    while len(parts) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
            if end > len(data):
                raise ValueError("header ends early")
        parts.append(data[at:end])
        at = end
    kind, width, height, top = parts[0], *map(int, parts[1:])
    if kind not in (b"P5", b"P6") or top != 255 or width < 1 or height < 1:
        raise ValueError("not a binary pixel map of one byte per sample")
    depth = 3 if kind == b"P6" else 1
    pixels = np.frombuffer(data, np.uint8, width * height * depth, at + 1).reshape(height, width, depth)
    return np.repeat(pixels, 3 // depth, axis=2)


def encode_pixmap(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def area_means(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resized image: each target pixel is the mean of the source area it covers (at least one pixel)."""
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1, pixels.shape[2]))
    sums[1:, 1:] = pixels.cumsum(0, dtype=np.float64).cumsum(1)
    lo = lambda n, m: np.arange(m) * n // m
    hi = lambda n, m: np.maximum((np.arange(m) + 1) * n // m, lo(n, m) + 1)
    y0, y1, x0, x1 = lo(pixels.shape[0], height), hi(pixels.shape[0], height), lo(pixels.shape[1], width), hi(pixels.shape[1], width)
    box = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    return box / ((y1 - y0)[:, None, None] * (x1 - x0)[None, :, None])


def grid_features(pixels: np.ndarray) -> np.ndarray:
    """768 numbers in [0, 1]: channel means of a 16 x 16 grid."""
    return (area_means(pixels, GRID, GRID) / 255.0).ravel()


def thumbnails(images: DataFrame, key: str, width: int = 400, decode=decode_pixmap, encode=encode_pixmap) -> DataFrame:
    """(key, ok, width, height, content): images of the given width, height max(1, whole part of the kept ratio)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                try:
                    px = decode(data)
                    height = max(1, px.shape[0] * width // px.shape[1])
                    rows.append((True, width, height, encode(np.round(area_means(px, height, width)))))
                except Exception:  # noqa: BLE001
                    rows.append((False, None, None, None))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=[key, "ok", "width", "height", "content"])

    kind = dict(images.dtypes)[key]
    return images.select(key, "content").mapInArrow(run, f"{key} {kind}, ok boolean, width int, height int, content binary")


def features(images: DataFrame, key: str, decode=decode_pixmap, encode=grid_features, unit: bool = False) -> DataFrame:
    """(key, vec): feature vector of each readable image, of length one with `unit`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, vecs = [], []
            for i, data in enumerate(b.column(1).to_pylist()):
                try:
                    v = np.asarray(encode(decode(data)), np.float64)
                except Exception:  # noqa: BLE001
                    continue
                at.append(i)
                vecs.append((v / max(np.linalg.norm(v), 1e-12) if unit else v).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(vecs, pa.list_(pa.float64()))], names=[key, "vec"])

    return images.select(key, "content").mapInArrow(run, f"{key} {dict(images.dtypes)[key]}, vec array<double>")


def captions(images: DataFrame, key: str, caption: Callable[[np.ndarray], str], decode=decode_pixmap) -> DataFrame:
    """(image_file, caption) by a captioning function, for visual.caption_triplets; unreadable images give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append((str(name), caption(decode(data))))
                except Exception:  # noqa: BLE001
                    continue
            cols = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], names=["image_file", "caption"])

    return images.select(key, "content").mapInArrow(run, "image_file string, caption string")
