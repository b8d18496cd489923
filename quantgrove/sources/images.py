"""Image folders: the class is the sub-folder; picture files, raw pixels, or C array text."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings of the picture files that are read.
ENDINGS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def text_pixels(body: Column) -> Column:
    """Integers between the braces of a C array."""
    inner = F.regexp_extract(body, r"(?s)\{([^}]*)\}", 1)
    return F.transform(F.regexp_extract_all(inner, F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))


def class_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def cap_classes(images: DataFrame, per_class: int) -> DataFrame:
    """The first so many of each class in order of path."""
    nth = F.row_number().over(Window.partitionBy("class").orderBy("path"))  # Spark cuts each task's part to the cap before it moves
    return images.withColumn("nth", nth).where(F.col("nth") <= per_class).drop("nth")


def read_text_images(spark: SparkSession, path: str, pixels: int | None = None, per_class: int | None = None) -> DataFrame:
    """class, path, image of every .txt file below; wrong sizes are left out, classes capped in order of path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").option("wholetext", "true").text(path).withColumn("path", F.input_file_name())
    out = files.select(class_of(F.col("path")).alias("class"), "path", text_pixels(F.col("value")).alias("image"))
    out = out.where(F.size("image") == pixels) if pixels else out
    return cap_classes(out, per_class) if per_class else out


def read_images(spark: SparkSession, path: str, width: int | None = None, height: int | None = None, per_class: int | None = None) -> DataFrame:
    """class, path, width, height, image (grey pixels) of every picture below.

    Spark's own image source decodes the files. Pictures of another size than
    wanted and files that cannot be decoded are left out; classes are capped in
    order of path.
    """
    files = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(x for e in ENDINGS for x in (e, e.upper()))}}}").load(path).select("image.*")
    files = files.where((F.col("width") == width) & (F.col("height") == height)) if width and height else files

    def grey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for channels, data in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(-1, channels).astype(np.int32)
                out.append(x[:, 0] if channels == 1 else (77 * x[:, 2] + 150 * x[:, 1] + 29 * x[:, 0]) >> 8)  # blue, green, red
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.int32()))], names=["path", "width", "height", "image"])

    images = files.select("origin", "width", "height", "nChannels", "data").mapInArrow(grey, "path string, width int, height int, image array<int>")
    images = images.select(class_of(F.col("path")).alias("class"), "path", "width", "height", "image")
    return cap_classes(images, per_class) if per_class else images


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit picture: height x width, or height x width x 3 for red, green, blue."""
    h, w = pixels.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def write_images(images: DataFrame, folder: str, width: int, height: int) -> int:
    """Write class, name, image (grey pixels) as folder/class/name.png from the tasks; returns how many."""
    from quantgrove.sources.packed import store_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, to = store_of(folder)
        for b in batches:
            for c, name, image in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                store.create_dir(f"{to}/{c}", recursive=True)
                with store.open_output_stream(f"{to}/{c}/{name}.png", compression=None) as out:
                    out.write(png(np.array(image, np.uint8).reshape(height, width)))
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], names=["n"])

    return images.select(F.col("class").cast("string"), F.col("name").cast("string"), "image").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
