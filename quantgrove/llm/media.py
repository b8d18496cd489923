"""Media columns: payloads as grey images in zip archives, read by a data source of our own.

``store`` turns each payload into an 8-bit grey PNG, 64 samples a row, and
each task appends its images to zip archives in the shared folder, closing one
as it reaches a size. The list of archives is a table in the shared folder.

``ArchiveSource`` reads them back. The driver plans byte ranges over the
archives from that list alone. A task reads its archive's central directory,
takes the members whose offset lies in its range, and streams them as Arrow
batches of bounded bytes. Every member is read on its own by its offset and
checked against the directory's CRC; a failed read is tried again from a fresh
handle, without touching the members around it. A member that still fails
ends the task with its name, so that no row is lost in silence.

``features`` decodes the stored bytes: a histogram over 16 grey levels, a
64-bit mean hash of an 8 x 8 thumbnail, and the dimensions.

Defined results: a null text counts as empty; the payload of an empty text is
64 zero bytes; a null doc_id is carried along; repeated rows are stored each.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quantgrove.llm.common import batch_of, documents_of, filesystem, materialise, scratch, write_once

#: Samples of an image row, bytes of an archive, of a planned range and of an Arrow batch, reads of a member.
SIDE, ARCHIVE, RANGE, BATCH, TRIES = 64, 32 << 20, 8 << 20, 4 << 20, 4
#: Ranges that a scan is planned in, about, whatever the total.
RANGES = 100_000
_SIGN = b"\x89PNG\r\n\x1a\n"


# --- the stored form ------------------------------------------------------


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(raw: bytes) -> bytes:
    """The bytes and as many zeros as lead to a positive multiple of 64."""
    return raw + bytes(-len(raw) % SIDE or (0 if raw else SIDE))


def to_image(payload: bytes, n_bytes: int) -> bytes:
    """Grey PNG of the payload; a text chunk says how many bytes are not padding."""
    rows = np.zeros((len(payload) // SIDE, SIDE + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_image(media: bytes) -> tuple[np.ndarray, int]:
    """(samples by row, bytes that are not padding) of such an image."""
    if media[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, data, n, shape = 8, [], 0, (0, 0)
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)[::-1]
        elif kind == b"tEXt":
            n = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that is not written here")
    return rows[:, 1:], n


# --- writing --------------------------------------------------------------


def store(documents: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write the archives of a table of texts; returns the list (path, members, data_bytes, size)."""
    listed = pa.schema([("path", pa.string()), ("members", pa.int64()), ("data_bytes", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task, number = context.partitionId() if context else 0, 0
        buffer, archive, members = io.BytesIO(), None, 0

        def close():
            nonlocal buffer, archive, members, number
            data = buffer.tell()
            archive.close()
            path = f"{folder}/part-{task:06d}-{number:05d}.zip"
            blob = buffer.getvalue()
            write_once(path, blob)
            row = batch_of(listed, {"path": [path], "members": [members], "data_bytes": [data], "size": [len(blob)]})
            buffer, archive, members, number = io.BytesIO(), None, 0, number + 1
            return row

        for b in batches:
            for doc_id, text in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                archive = archive or zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                name = f"{members:08d}_{'null' if doc_id is None else doc_id}.png"
                archive.writestr(zipfile.ZipInfo(name), to_image(padded(raw), len(raw)))
                members += 1
                if buffer.tell() >= archive_bytes:
                    yield close()
        if members:
            yield close()

    rows = documents_of(documents).mapInArrow(run, "path string, members long, data_bytes long, size long")
    return materialise(rows, "archives")


# --- reading --------------------------------------------------------------


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def read_member(path: str, info: zipfile.ZipInfo, tries: int = TRIES, pause: float = 0.2, opener=None) -> tuple[bytes, int]:
    """(bytes, reads it took) of one stored member, by its offset."""
    fs, at = filesystem(path)
    opener = opener or fs.open_input_file
    for attempt in range(1, tries + 1):
        try:
            with opener(at) as f:
                f.seek(info.header_offset)
                head = f.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member here")
                names = sum(struct.unpack_from("<HH", head, 26))
                f.seek(info.header_offset + 30 + names)
                data = f.read(info.file_size)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise OSError("member differs from the directory's CRC")
            return data, attempt
        except OSError as e:
            if attempt == tries:
                raise OSError(f"{path}, {info.filename} at {info.header_offset}: {e}, {tries} times") from e
            time.sleep(pause * attempt)
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Byte ranges over the listed archives; one list entry per archive reaches the driver.

        Ranges grow with the whole, so that their number stays below ``RANGES``
        and one for each archive.
        """
        fs, at = filesystem(self.options["list"])
        import pyarrow.dataset as ds

        table = ds.dataset(at, filesystem=fs, format="parquet").to_table(columns=["path", "data_bytes"])
        paths, sizes, out = table["path"].to_pylist(), table["data_bytes"].to_pylist(), []
        step = max(int(self.options.get("range_bytes", RANGE)), sum(sizes) // RANGES)
        for path, size in zip(paths, sizes, strict=True):
            out += [ByteRange(path, i, min(i + step, size)) for i in range(0, size, step)]
        return sorted(out, key=lambda r: (r.path, r.start)) or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("at", pa.int64()), ("reads", pa.int32()), ("media", pa.binary())])
        if not partition.path:
            return
        fs, at = filesystem(partition.path)
        tries = int(self.options.get("tries", TRIES))
        with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            infos = [i for i in z.infolist() if partition.start <= i.header_offset < partition.stop]
        out, held = {f.name: [] for f in schema}, 0
        for info in infos:
            media, reads = read_member(partition.path, info, tries)
            name = info.filename.rpartition("_")[2].removesuffix(".png")
            for k, v in zip(out, (None if name == "null" else int(name), partition.path, info.header_offset, reads, media), strict=True):
                out[k].append(v)
            held += len(media)
            if held >= BATCH:
                yield batch_of(schema, out)
                out, held = {f.name: [] for f in schema}, 0
        if out["doc_id"]:
            yield batch_of(schema, out)


class ArchiveSource(DataSource):
    """``spark.read.format("media_archives").option("list", ...)``: doc_id, archive, at, reads, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, archive string, at long, reads int, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def load(spark: SparkSession, listed: DataFrame, **options) -> DataFrame:
    """Members of the archives in a list that ``store`` made."""
    spark.dataSource.register(ArchiveSource)
    folder = listed.inputFiles()[0].rpartition("/")[0] if listed.inputFiles() else ""
    reader = spark.read.format("media_archives").option("list", folder)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


# --- features -------------------------------------------------------------


def feature_of(samples: np.ndarray) -> str:
    """Height, grey histogram in per mille over 16 levels, and 64-bit mean hash."""
    n = samples.size
    levels = np.bincount(samples.ravel() >> 4, minlength=16) * 1000 // n
    rows = np.minimum(np.arange(8) * len(samples) // 8, len(samples) - 1)
    thumb = np.add.reduceat(samples.astype(np.int64).reshape(len(samples), 8, 8).sum(2), rows, axis=0)
    count = np.maximum(np.diff(np.append(rows, len(samples))), 1) * 8
    thumb = thumb / count[:, None]
    bits = (thumb > thumb.mean()).ravel()
    return f"{len(samples)}x{samples.shape[1]};{','.join(map(str, levels))};{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def features(media: DataFrame) -> DataFrame:
    """Sizes, digests and feature of every stored member."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {f.name: [] for f in out}
            for doc_id, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                samples, n = from_image(m)
                payload = samples.tobytes()
                row = (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SIDE:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(samples))
                for k, v in zip(cols, row, strict=True):
                    cols[k].append(v)
            yield batch_of(out, cols)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def folder_for(spark: SparkSession) -> str:
    return scratch(spark, "media")
