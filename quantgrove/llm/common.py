"""Helpers shared by the training-data operators: the shared folder, Arrow iteration, fold rule."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    master may go without that setting; a folder of its own is then made and
    set, so that ``checkpoint()`` works too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        found = f"file://{tempfile.mkdtemp(prefix='quantgrove-')}"
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quantgrove/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder and read again.

    Unlike a cached block, the files outlive any executor. ``files`` bounds
    their number, where the caller knows the table to be small for its
    partitions.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """(file system, path in it) for a shared path; the scheme picks the store."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_once(path: str, data: bytes) -> None:
    """Write a file under a name of this attempt, then move it into place.

    A repeated or speculative attempt writes the same bytes and replaces the
    file as a whole, so that a reader never sees part of one.
    """
    fs, at = filesystem(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, at)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; tables may carry others of any name."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Rows and bytes of an Arrow batch: Spark's default of 10000 rows may be hundreds of MB of long texts, in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session that hands texts to Python in batches of bounded rows and bytes.

    Results are read lazily, when the settings must still hold, so they stay
    set; a session that has smaller ones keeps them.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = conf.get(key).lower().removesuffix("b")
        if not (found.isdigit() and 0 < int(found) <= most):
            conf.set(key, most)
    return df


def documents_of(df: DataFrame) -> DataFrame:
    """(doc_id long, text string): a null text counts as empty."""
    df = in_small_batches(df)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_by_hash(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of the key, all where there are no more; keys are distinct.

    A first cut leaves each task few rows to offer, so what reaches the driver
    stays near the bound however many tasks there are. It lets ten standard
    deviations more than ``most`` rows through, so that none is missed.
    """
    h, n = F.xxhash64(key), df.count()
    wanted = most + 10 * math.isqrt(most) + 50
    if n > wanted:  # then the bound is below 2^63
        df = df.where(h <= -(2**63) + wanted * 2**64 // n)
    return df.orderBy(h, key).limit(most)


def exact_key(text: str) -> bytes:
    """128-bit hash that tells different texts apart."""
    import xxhash

    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def batch_of(schema: pa.Schema, cols: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, one batch in memory at a time."""
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
