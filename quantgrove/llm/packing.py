"""Hierarchical multi-length packing of token sequences.

Documents are routed to context tiers by length. Each tier opens windows of
its own size, longest tier first; what a document leaves free in its window is
filled with the longest fitting documents of the shorter tiers, and only when
none fits whole, one is cut. So every window is exactly full, and only the
last few of a task are short: those are cut at powers of two, down to single
ids, which need no padding either. Sequences are then dealt to step groups of
equal token budget, longest first to the emptiest group.

All of it happens where a document is read, block by block, without a
shuffle: memory is bounded by a block plus one document. Sequence and group
numbers are made from the task's number and a count, and a task that is run
again reads the same rows in the same order, so lost executors change nothing.

Defined results: a null text counts as empty and is packed as its end id
alone; a null doc_id is carried along; repeated rows are packed each. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantgrove.llm.common import batch_of, documents_of
from quantgrove.llm.tokens import default_tokenizer, encoder

#: Context tiers, ids of a block that is packed at once, ids of a step group.
TIERS, BLOCK, STEP = (512, 1024, 2048, 4096), 1 << 20, 1 << 16
ROWS = 4000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class _Pool:
    """Pieces (document, start, length) waiting for a place, by length."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.lengths: list[int] = []

    def add(self, doc: int, start: int, length: int) -> None:
        if not self.by[length]:
            insort(self.lengths, length)
        self.by[length].append((doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most that length."""
        i = bisect_right(self.lengths, most) - 1
        if i < 0:
            return None
        length = self.lengths[i]
        doc, start = self.by[length].pop()
        if not self.by[length]:
            del self.lengths[i]
        return doc, start, length


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """(windows, rest): windows are (size, pieces) and exactly full; a piece is (document, start, length).

    The rest is what fills no window; with ``last`` it is cut at powers of two
    and none remains.
    """
    top, pool, windows = tiers[-1], _Pool(), []
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            windows.append((top, [(doc, at, top)]))
            at += top
        if n - at:
            pool.add(doc, at, n - at)
    rest: list[tuple[int, int, int]] = []
    while first := pool.take(top):
        size = next(t for t in tiers if t >= first[2])  # the tier that this length is routed to
        pieces, room = [first], size - first[2]
        while room:
            if (p := pool.take(room)) is None:
                if (p := pool.take(top)) is None:
                    break
                pool.add(p[0], p[1] + room, p[2] - room)
                p = (p[0], p[1], room)
            pieces.append(p)
            room -= p[2]
        if room:
            rest = pieces
        else:
            windows.append((size, pieces))
    if last and rest:
        left = sum(p[2] for p in rest)
        bits, i, used = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1], 0, 0
        for size in bits:
            pieces, room = [], size
            while room:
                doc, start, length = rest[i]
                n = min(room, length - used)
                pieces.append((doc, start + used, n))
                room, used = room - n, used + n
                if used == length:
                    i, used = i + 1, 0
            windows.append((size, pieces))
        rest = []
    return windows, rest


def step_groups(sizes: list[int], step: int = STEP) -> list[int]:
    """Group of every sequence: the longest first, each to the group with the fewest ids."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        full, g = groups[0]
        heapq.heapreplace(groups, (full + sizes[i], g))
        out[i] = g
    return out


def pack(documents: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    path = tokenizer or default_tokenizer()
    assert all(t & (t - 1) == 0 for t in tiers) and list(tiers) == sorted(tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, context = encoder(path), TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        waiting: list[tuple] = []  # (doc_id, ids, first id of the part that waits, its length)
        sequences = groups = held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, sequences, groups, held
            windows, rest = plan([w[3] for w in waiting], tiers, last)
            out: dict[str, list] = {f.name: [] for f in schema}
            dealt = step_groups([size for size, _ in windows], step) if windows else []
            for (size, pieces), group in zip(windows, dealt, strict=True):
                offset = 0
                for d, at, n in pieces:
                    doc_id, ids, first, _ = waiting[d]
                    at += first
                    row = (doc_id, at, n, crc32(ids[at : at + n].astype("<u4").tobytes()), len(ids), base + sequences, offset, size, base + groups + group)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                    offset += n
                sequences += 1
                if len(out["doc_id"]) >= ROWS:
                    yield batch_of(schema, out)
                    out = {f.name: [] for f in schema}
            groups += max(dealt, default=-1) + 1
            waiting = [(waiting[d][0], waiting[d][1], waiting[d][2] + at, n) for d, at, n in rest]
            held = sum(w[3] for w in waiting)
            if out["doc_id"]:
                yield batch_of(schema, out)

        for b in batches:
            doc_ids, texts = (b.column(i).to_pylist() for i in range(2))
            for i in range(0, len(texts), 256):
                for doc_id, ids in zip(doc_ids[i : i + 256], tokens.encode(texts[i : i + 256]), strict=True):
                    waiting.append((doc_id, ids, 0, len(ids)))
                    held += len(ids)
                if held >= block:
                    yield from flush(False)
        yield from flush(True)

    return documents_of(documents).mapInArrow(run, SCHEMA)
