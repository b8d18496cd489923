"""Token files: frequency-ranked ids as variable bytes, lengths apart in control bytes.

Ids are renumbered by how often they occur in the whole corpus, so that the
commonest take one byte. A rank is written in one to four bytes; its length,
in two bits, goes to a control byte shared by four ranks and kept apart from
the data bytes. A reader looks each control byte up in a numpy table that
gives the places of sixteen target bytes at once, so it decodes a file without
a loop over ids.

Rows are sorted by range of (doc_id, hash of the ids), so that even one id that
a third of all rows share is spread; each task writes its range as files of
bounded size, under the name of the range and a number. A file is moved into
place as a whole; the list of files, with the number of ids before each, is
itself a table in the shared folder, so a lost executor costs the files it was
writing and nothing else.

Defined results: a null text counts as empty (the end id alone), null doc_ids
come first, equal doc_ids follow each other by a hash of their ids, repeated
rows are all kept. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantgrove.llm.common import batch_of, documents_of, filesystem, materialise, scratch, write_once
from quantgrove.llm.tokens import default_tokenizer, encoder

MAGIC = b"QGRV0002"
_HEAD = struct.Struct("<8sQQQ")  # magic, documents, ids, data bytes
#: Ids after which a file is closed: what a task holds is these and one document more. Tasks that write, at most; each writes as many files as its rows need.
FILE_IDS, TASKS = 1 << 21, 50_000


# --- the coding -----------------------------------------------------------

_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
#: Data bytes that a control byte stands for.
_TOTAL = (_CODES + 1).sum(1)
_STARTS = np.cumsum(_CODES + 1, axis=1) - (_CODES + 1)
#: Place, after the group's first data byte, of each of the 16 target bytes; -1 where it is zero.
_PLACES = np.where(np.arange(4) <= _CODES[:, :, None], _STARTS[:, :, None] + np.arange(4), -1).reshape(256, 16)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit integers."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = code
    control = padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers, by one table lookup per control byte."""
    out = np.empty((len(control), 16), np.uint8)
    c, d = np.frombuffer(control, np.uint8), np.frombuffer(data + bytes(16), np.uint8)
    at = np.concatenate([[0], np.cumsum(_TOTAL[c])])
    for i in range(0, len(c), 1 << 16):  # bounded index arrays
        places = _PLACES[c[i : i + (1 << 16)]]
        got = d[at[i : i + len(places), None] + np.maximum(places, 0)]
        got[places < 0] = 0
        out[i : i + len(places)] = got
    return out.reshape(-1).view("<u4")[:n]


def pack_file(doc_ids: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode(ranks)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data))
    return b"".join([head, known.tobytes(), ids.tobytes(), np.array(lengths, "<u8").tobytes(), control, data])


def unpack_file(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ranks) of a file."""
    magic, docs, n, size = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size
    known = np.frombuffer(blob, np.uint8, docs, at)
    ids = np.frombuffer(blob, "<i8", docs, at + docs)
    lengths = np.frombuffer(blob, "<u8", docs, at + 9 * docs)
    at += 17 * docs
    m = -(-n // 4)
    ranks = decode(blob[at : at + m], blob[at + m : at + m + size], n)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist())], lengths, ranks


# --- the store ------------------------------------------------------------


@cache
def _codec() -> pa.Codec:
    """For ids between the two passes: under half the time of zlib at level 1, 2 % more bytes (52 MB of check_l)."""
    return pa.Codec("zstd", compression_level=3)


@cache
def _ranking(path: str) -> np.ndarray:
    """Id of every rank, as the store's table of ranks has them."""
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read(), "<u4")


def write(documents: DataFrame, folder: str, tokenizer: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the token files of a table to a folder; returns the list of files (path, first, docs, ids, bytes)."""
    spark, path = documents.sparkSession, tokenizer or default_tokenizer()
    counted = pa.schema([("ord", pa.int64()), ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("id", pa.int32()), ("n", pa.int64())])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, squeeze = encoder(path), _codec().compress
        counts = np.zeros(tokens.size, np.int64)
        for b in batches:
            doc_ids, texts = (b.column(i).to_pylist() for i in range(2))
            for i in range(0, len(texts), 1000):
                some, ids = doc_ids[i : i + 1000], tokens.encode(texts[i : i + 1000])
                counts += np.bincount(np.concatenate(ids), minlength=tokens.size)
                none = [None] * len(ids)
                yield batch_of(counted, {"ord": [-(2**63) if d is None else d for d in some], "doc_id": some, "n_ids": list(map(len, ids)), "ids": [squeeze(x.tobytes(), asbytes=True) for x in ids], "id": none, "n": none})
        seen = np.flatnonzero(counts)
        none = [None] * len(seen)
        yield batch_of(counted, {"ord": none, "doc_id": none, "n_ids": none, "ids": none, "id": seen.tolist(), "n": counts[seen].tolist()})

    rows = materialise(documents_of(documents).mapInArrow(tokenise, "ord long, doc_id long, n_ids long, ids binary, id int, n long"), "token-ids")

    # As many rows as the vocabulary has ids, whatever the corpus.
    counts = rows.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranking = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], "<u4")
    ranks_at = f"{folder}/ranks.u32"
    write_once(ranks_at, ranking.tobytes())

    docs = rows.where("ids is not null").select("ord", "doc_id", F.xxhash64("ids").alias("tie"), "n_ids", "ids")
    total = rows.agg(F.sum("n_ids")).first()[0] or 0
    listed = pa.schema([("path", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, number = context.partitionId() if context else 0, 0
        to_rank = np.zeros(1 << 16, np.uint32)
        order, expand = _ranking(ranks_at), _codec().decompress
        to_rank[order] = np.arange(len(order))
        doc_ids, lengths, ranks, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            blob, at = pack_file(doc_ids, lengths, np.concatenate(ranks)), f"{folder}/part-{part:06d}-{number:06d}.tok"
            write_once(at, blob)
            return batch_of(listed, {"path": [at], "part": [part], "number": [number], "docs": [len(doc_ids)], "ids": [held], "bytes": [len(blob)]})

        for b in batches:
            for doc_id, n_ids, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got = np.frombuffer(expand(ids, 2 * n_ids), "<u2")
                doc_ids.append(doc_id)
                lengths.append(len(got))
                ranks.append(to_rank[got])
                held += len(got)
                if held >= file_ids:
                    yield close()
                    number, doc_ids, lengths, ranks, held = number + 1, [], [], [], 0
        if doc_ids:
            yield close()

    tasks = max(1, min(TASKS, -(-total // file_ids)))
    spread = docs.repartitionByRange(tasks, "ord", "tie").sortWithinPartitions("ord", "tie", "ids").select("doc_id", "n_ids", "ids")
    files = materialise(spread.mapInArrow(store, "path string, part int, number int, docs long, ids long, bytes long"), "token-list")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a thin row a file
    return materialise(files.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"), "docs", "ids", "bytes"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """Documents of the listed files: doc_id, start, n_tokens, ids_crc32 and ids (unsigned, as bytes)."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    doc_ids, lengths, ranks = unpack_file(f.read())
                ids = _ranking(f"{path.rpartition('/')[0]}/ranks.u32")[ranks]
                stops = np.cumsum(lengths.astype(np.int64))
                starts = stops - lengths.astype(np.int64)
                for i in range(0, len(doc_ids), 1000):
                    each = [ids[a:z].tobytes() for a, z in zip(starts[i : i + 1000], stops[i : i + 1000])]
                    yield batch_of(out, {"doc_id": doc_ids[i : i + 1000], "start": (before + starts[i : i + 1000]).tolist(), "n_tokens": lengths[i : i + 1000].astype(np.int64).tolist(), "ids_crc32": list(map(crc32, each)), "ids": each})

    spark = files.sparkSession
    spread = files.select("path", "first").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def folder_for(spark: SparkSession) -> str:
    return scratch(spark, "tokens")
