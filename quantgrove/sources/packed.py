"""The packed binary exchange format: u32 rows, u16 features, then a label byte and bit-packed bins a row.

Values are little-endian; bins lie lowest bit first and may straddle bytes.
Inside the engine Parquet does this job; the codec is for exchange.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: u32 rows, u16 features.
HEAD, HEAD_SIZE = "<IH", 6


def row_bytes(features: int, bits: int) -> int:
    return 1 + -(-features * bits // 8)


def encode(labels: np.ndarray, bins: np.ndarray, bits: int) -> bytes:
    """Rows as bytes, without header; bins saturate at the width."""
    n, f = bins.shape
    values = np.minimum(bins, (1 << bits) - 1).astype(np.uint8)
    planes = np.unpackbits(values[:, :, None], axis=2, bitorder="little")[:, :, :bits].reshape(n, f * bits)
    return np.concatenate([labels.astype(np.uint8)[:, None], np.packbits(planes, axis=1, bitorder="little")], axis=1).tobytes()


def decode(data: bytes, features: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(data, np.uint8).reshape(-1, row_bytes(features, bits))
    planes = np.unpackbits(rows[:, 1:], axis=1, bitorder="little")[:, : features * bits].reshape(len(rows), features, bits)
    return rows[:, 0].copy(), np.packbits(planes, axis=2, bitorder="little")[:, :, 0]


#: Rows of one file of a folder, and of one read.
FILE_ROWS, CHUNK_ROWS = 1 << 22, 100_000


def store_of(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write(df: DataFrame, folder: str, label: str, bins: list[str], bits: int, order: list[str] | None = None, file_rows: int = FILE_ROWS) -> int:
    """Write a folder of packed files, each whole with its own header; returns the rows written.

    Each task writes its own rows, under another name first, and moves the
    whole file into place; the rows in memory are those of one file. With
    ``order`` rows are sorted by range, so that files in order of their names
    hold the table in order. A body is checked against its header's size.
    """
    rows = df.select(label, *bins) if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order).select(label, *bins)
    store, at = store_of(folder)
    store.create_dir(at, recursive=True)

    def put(part: int, number: int, held: list[bytes], n: int) -> pa.RecordBatch:
        own, to = store_of(folder)
        body = b"".join(held)
        if len(body) != n * row_bytes(len(bins), bits):
            raise ValueError("rows of another size than the header says")
        name = f"part-{part:06d}-{number:04d}.bin"
        temporary = f"{to}/{name}.{uuid.uuid4().hex}.tmp"
        with own.open_output_stream(temporary, compression=None) as out:
            out.write(struct.pack(HEAD, n, len(bins)) + body)
        own.move(temporary, f"{to}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, number, held, n = context.partitionId() if context else 0, 0, [], 0
        for b in batches:
            at = 0
            while at < len(b):
                some = b.slice(at, min(len(b) - at, file_rows - n))
                values = np.stack([some.column(j + 1).to_numpy(zero_copy_only=False) for j in range(len(bins))], 1)
                held.append(encode(some.column(0).to_numpy(zero_copy_only=False), values, bits))
                at, n = at + len(some), n + len(some)
                if n == file_rows:
                    yield put(part, number, held, n)
                    number, held, n = number + 1, [], 0
        if n:
            yield put(part, number, held, n)

    return rows.mapInArrow(run, "path string, rows long").agg(F.sum("rows")).first()[0] or 0


def files_of(path: str) -> list[tuple[str, int, int]]:
    """(path, rows, features) of a file, or of the whole files of a folder in order of name, by their headers."""
    from pyarrow import fs

    store, at = store_of(path)
    info = store.get_file_info(at)
    found = [at] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".bin"))
    out = []
    for p in found:
        with store.open_input_file(p) as f:
            out.append((p, *struct.unpack(HEAD, f.read(HEAD_SIZE))))
    return out


def read(spark: SparkSession, path: str, bits: int, chunk_rows: int = CHUNK_ROWS, remap: dict[int, Sequence[int]] | None = None) -> DataFrame:
    """row_id, label, bins of a file or a folder: tasks read ranges of rows by offset.

    ``remap`` is the change of bins that is still due for the stored rows, by
    feature: each row gets it once, as it is read. A file of another size than
    its header says is an error.
    """
    listed = files_of(path)
    ranges, before = [], 0
    for p, n, features in listed:
        ranges += [(p, before, i, min(chunk_rows, n - i), n, features) for i in range(0, n, chunk_rows)]
        before += n
    table = spark.createDataFrame(ranges or [("", 0, 0, 0, 0, 0)], "path string, before long, start long, n int, total long, features int")
    due = {f: np.asarray(to, np.uint8) for f, to in (remap or {}).items()}

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if not r["n"]:
                    continue
                size = row_bytes(r["features"], bits)
                with store_of(path)[0].open_input_file(r["path"]) as f:
                    if f.size() != HEAD_SIZE + r["total"] * size:
                        raise ValueError(f"{r['path']} has another size than its header says")
                    f.seek(HEAD_SIZE + r["start"] * size)
                    labels, bins = decode(f.read(r["n"] * size), r["features"], bits)
                for j, to in due.items():
                    bins[:, j] = to[bins[:, j]]
                first = r["before"] + r["start"]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bins.size + 1, bins.shape[1], dtype=np.int32)), pa.array(bins.astype(np.int16).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(labels))), pa.array(labels.astype(np.int32)), flat], names=["row_id", "label", "bins"])

    return table.repartition(max(1, len(ranges))).mapInArrow(load, "row_id long, label int, bins array<smallint>")


def register_decoder(spark: SparkSession, name: str = "unpack_rows") -> None:
    """SQL table function: (label, bins) of a body of packed rows, given the number of features and the bits of a bin."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="label int, bins array<smallint>")
    class Unpack:
        def eval(self, data: bytes, features: int, bits: int):
            labels, bins = decode(bytes(data), features, bits)
            for label, row in zip(labels.tolist(), bins.tolist()):
                yield label, row

    spark.udtf.register(name, Unpack)
