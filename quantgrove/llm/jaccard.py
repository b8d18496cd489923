"""Near copies by an exact set similarity join on word shingles, with adaptive multi-match prefixes.

A document's set holds its distinct five-word shingles. Shingles have one
global order, rarest first by a counting sketch of fixed size. Two sets with
a Jaccard likeness of t or more share at least l shingles among the first
n - ceil(t n) + l of each, for every l (and the smaller of the two needs still
fewer of its own). So a document may lengthen its prefix
and ask for more shared shingles in return: l is chosen for each document from
the estimated number of candidates that its prefix would draw, and a pair must
share as many as the smaller l of the two before it is verified.

What would grow with the square of a group is never made:

* equal sets are one class, and only classes are compared;
* shingles of a prefix that only one class has are dropped at once;
* of the classes that share a shingle, each is first compared with one hub
  (one that shares most of its own prefix), and only with the few hubs that it
  shares most with; what is linked becomes one component, and this repeats
  while it pays off;
* then every pair that is left, of classes in different components, goes
  through the multi-match filter and verification. Pairs inside a component
  are not needed for the result, so no link between components is lost. For a
  shingle that many classes have, blocks of signatures are compared instead of
  joining rows.

A signature has a bit for each hash value that the set's shingles flip; two
signatures differ in no more bits than the sets in shingles, so pairs that
differ in too many are dismissed without their texts.

Hot shingles are split by salts in proportion to the sketch's count. Texts
that take part in a comparison are kept once per class, compressed.

Defined results: a null or empty text, or one without words, has the empty
set and is linked with nothing; fewer words than a shingle form one shingle.
A component's id is its smallest doc_id; rows with a null doc_id take part,
and a component of such rows only has a null id. Classes are told apart by a
64-bit hash of their set. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quantgrove.llm.common import batch_of, documents_of, exact_key, in_small_batches, materialise

#: Words of a shingle; the likeness asked for, in hundredths; largest l; bits of the sketch; rows of a salt.
WIDTH, PERCENT, MOST_MATCHES, BITS, SALTED = 5, 75, 4, 18, 20_000
#: Hub rounds at most; how many pair rows for each row of a prefix the last step may make before another round is tried; hubs that a class is compared with in a round; share of links among them below which no further round is made.
ROUNDS, PAYS, HUBS, GAIN = 4, 8, 3, 0.5
#: Rows of a prefix for each file of the tables that are made from them.
FILE_ROWS = 40_000
_BLOCK = 1 << 12
#: Shingles that a task counts at once.
_COUNTED = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        back = np.uint64(pow(int(_P), -1, 1 << 64))
        _POWERS = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, _P))])
        _INVERSES = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, back))])
    return _POWERS[:n], _INVERSES[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of every word: polynomials of its bytes, all words at once from running sums."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # of bytes: A-Z only
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64)
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[raw]
    turn = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turn[::2], turn[1::2]
    powers, inverses = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * inverses[:n], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; only A-Z are lower-cased, words end at ASCII white space."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    w = min(width, n)
    acc = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        acc *= _P
        acc += h[i : n - w + 1 + i]
    acc = _mix(acc)
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def class_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares at least with any set that it links with."""
    return -(-percent * n // 100)


def least_overlap_up(n: int, percent: int = PERCENT) -> int:
    """The same with sets that are no smaller than it."""
    return -(-2 * percent * n // (100 + percent))


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signature(s: np.ndarray) -> bytes:
    """Bits that each shingle of the set flips: a power of two of them, twice the set at least."""
    size = max(64, min(1 << 15, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) as they would be with fewer bits."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def most_apart(n, m, percent: int = PERCENT):
    """Shingles that only one of two sets of these sizes has, at most, if they link."""
    return (n + m) * (100 - percent) // (100 + percent)


def _counter(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def prefix(s: np.ndarray, counts: np.ndarray, usual: float, percent: int = PERCENT, most: int = MOST_MATCHES) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(shingles of the prefix, their counts, whether in the lead, l) of a sorted set under the order by count, then hash.

    The lead is the shorter prefix that does where the other set is no smaller.
    """
    n = len(s)
    c = counts[_counter(s, counts.size.bit_length() - 1)].astype(np.int64)
    order = np.argsort(c, kind="stable")  # ties stay in order of hash
    need = least_overlap(n, percent)
    first = order[: n - need + 1]
    cost = float(np.maximum(c[first] - 2 * usual, 0).sum()) / len(first)
    l = max(1, min(most, need, 1 + int(np.log2(1 + cost / 8))))
    chosen = order[: n - need + l]
    lead = np.arange(len(chosen)) < n - least_overlap_up(n, percent) + l
    return s[chosen], c[chosen], lead, l


# --- passes over the texts ------------------------------------------------


def _classes(docs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, cid, n) of every row, and the sketch's counts of every task in blocks."""
    out = pa.schema([("doc_id", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        counts, held, n = np.zeros(1 << bits, np.uint32), [], 0
        for b in batches:
            doc_ids, texts = (b.column(i).to_pylist() for i in range(2))
            for i in range(0, len(texts), 256):
                each = [shingles(t) for t in texts[i : i + 256]]
                held.append(_counter(np.concatenate(each), bits))
                n += len(held[-1])
                if n >= _COUNTED:
                    counts += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
                    held, n = [], 0
                none = [None] * len(each)
                yield batch_of(out, {"doc_id": doc_ids[i : i + 256], "cid": [class_of(s) if len(s) else None for s in each], "n": list(map(len, each)), "block": none, "task": none, "counts": none})
        if n:
            counts += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
        if counts.any():
            parts = [compress(counts[i : i + _BLOCK].tobytes(), 1) for i in range(0, 1 << bits, _BLOCK)]
            none = [None] * len(parts)
            yield batch_of(out, {"doc_id": none, "cid": none, "n": none, "block": list(range(len(parts))), "task": [task] * len(parts), "counts": parts})

    return materialise(docs.mapInArrow(run, "doc_id long, cid long, n long, block int, task int, counts binary"), "classes")


def _sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """The tasks' counts summed, 256 tasks at a time and then all: as large as the sketch, whatever the corpus."""
    ddl = "block int, task int, counts binary"

    def total(key, table):
        counts = np.zeros(_BLOCK, np.int64)
        for x in table["counts"].to_pylist():
            counts += np.frombuffer(decompress(x), np.uint32)
        counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "task": pa.array([0], pa.int32()), "counts": pa.array([compress(counts.tobytes(), 1)], pa.binary())})

    some = rows.where("counts is not null").select("block", F.shiftright("task", 8).alias("task"), "counts")
    done = some.groupBy("block", "task").applyInArrow(total, ddl).groupBy("block").applyInArrow(total, ddl).collect()
    out = np.zeros(1 << bits, np.uint32)
    for r in done:
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(decompress(r["counts"]), np.uint32)
    return out


def _postings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, cid, n, l, lead, share): prefix shingles that more than one class has (or may have).

    ``share`` is how much of the set is commoner than usual, in per mille.
    """
    sent, usual = docs.sparkSession.sparkContext.broadcast(counts), float(np.median(counts))
    out = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("cid", pa.int64()), ("n", pa.int32()), ("l", pa.int32()), ("lead", pa.int32()), ("share", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = sent.value, set()
        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), 256):
                cols: list[list] = [[] for _ in out]
                for t in texts[i : i + 256]:
                    s = shingles(t)
                    if not len(s) or (cid := class_of(s)) in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(cid)
                    tokens, c, lead, l = prefix(s, known, usual)
                    salts = np.maximum(c - 2 * usual, 0).astype(np.int64) // SALTED
                    for col, v in zip(cols, (tokens.view(np.int64), np.where(salts > 0, (cid >> 7) % (salts + 1), -1), np.full(len(c), cid), np.full(len(c), len(s)), np.full(len(c), l), lead.astype(np.int32), np.full(len(c), 1000 * int((c > 2 * usual).sum()) // len(s))), strict=True):
                        col.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(cols, out)], schema=out)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent_held = None, False  # the last row so far, and whether it went out
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            t, s, c = cols[:3]
            first = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
            keep = first | np.concatenate([[True], c[1:] != c[:-1]])
            cols, first = [x[keep] for x in cols], first[keep]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(first)))
            go = np.repeat(sizes > 1, sizes) | (cols[1] >= 0)
            held, was, sent_held = [x[-1:] for x in cols], sent_held, bool(go[-1])
            if was:
                go[0] = False
            if go.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[go]) for x in (cols[0], *cols[2:])], names=["token", "cid", "n", "l", "lead", "share"])

    rows = docs.select("text").mapInArrow(emit, "token long, salt int, cid long, n int, l int, lead int, share int")
    return materialise(rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "cid").mapInArrow(shared, "token long, cid long, n int, l int, lead int, share int"), "postings")


#: Most bits of the filter by which the pass over the texts passes over classes without postings: 16 MB; a full filter only lets more through.
FILTER_BITS = 27


def _texts(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(cid, n, signature, text compressed), once for every class that has postings (and a few that the filter lets through)."""
    classes = materialise(postings.select("cid").distinct(), "shared-classes")
    size = 1 << max(16, min(FILTER_BITS, (16 * classes.count()).bit_length()))
    out = pa.schema([("cid", pa.int64()), ("size", pa.int32()), ("sig", pa.binary()), ("z", pa.binary())])

    def places(cids: np.ndarray) -> list[np.ndarray]:
        u = cids.view(np.uint64)
        return [(u >> np.uint64(k * 20)) & np.uint64(size - 1) for k in (0, 1, 2)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            for at in places(b.column(0).to_numpy()):
                bits[at] = True
        packed = np.packbits(bits)
        hit = [i for i in range(0, len(packed), _BLOCK) if packed[i : i + _BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // _BLOCK for i in hit], pa.int32()), pa.array([packed[i : i + _BLOCK].tobytes() for i in hit], pa.binary())], names=["block", "bits"])

    def either(key, table):
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    packed = np.zeros(size // 8, np.uint8)
    for r in classes.mapInArrow(mark, "block int, bits binary").groupBy("block").applyInArrow(either, "block int, bits binary").collect():  # as large as the filter
        packed[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known, seen, z = sent.value, set(), zstandard.ZstdCompressor(3)
        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), 256):
                sets = [shingles(t) for t in texts[i : i + 256]]
                cids = np.array([class_of(s) if len(s) else 0 for s in sets], np.int64)
                hit = np.logical_and.reduce([known[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1 for at in places(cids)]) & np.array([len(s) > 0 for s in sets], bool)
                got: dict[int, tuple] = {}
                for k in np.flatnonzero(hit).tolist():
                    if (cid := int(cids[k])) not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(cid)
                        got[cid] = len(sets[k]), signature(sets[k]), z.compress(texts[i + k].encode("utf-8", "surrogatepass"))
                if got:
                    yield batch_of(out, {"cid": list(got)} | {f.name: [v[j] for v in got.values()] for j, f in enumerate(list(out)[1:])})

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            cids = b.column(0).to_numpy()
            new = np.concatenate([[last is None or cids[0] != last], cids[1:] != cids[:-1]])
            last = cids[-1]
            yield b.filter(pa.array(new))

    rows = docs.select("text").mapInArrow(squeeze, "cid long, size int, sig binary, z binary")
    return materialise(rows.repartition("cid").sortWithinPartitions("cid").mapInArrow(once, "cid long, size int, sig binary, z binary"), "texts")


# --- pairs and components -------------------------------------------------


def _plausible(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose signatures differ in no more bits than linked sets' may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, p, q = (b.column(i).to_pylist() for i in range(2, 6))
            yes = []
            for i, j, u, v in zip(n, m, p, q):
                u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                words = min(len(u), len(v))
                yes.append(int(np.bitwise_count(_folded(u, words) ^ _folded(v, words)).sum()) <= most_apart(i, j, percent))
            yes = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(yes), b.column(1).filter(yes)], names=["x", "y"])

    sig = texts.select("cid", "size", "sig")
    both = pairs.select("x", "y").join(sig.toDF("y", "m", "q"), "y").join(sig.toDF("x", "n", "p"), "x")
    return both.select("x", "y", "n", "m", "p", "q").mapInArrow(run, "x long, y long")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose sets are alike. Many x may share a y: its text is joined first, to thin rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, known = zstandard.ZstdDecompressor(), {}

        def of(cid: int, data: bytes) -> np.ndarray:
            if cid not in known:
                if len(known) > 2000:
                    known.clear()
                known[cid] = shingles(z.decompress(data).decode("utf-8", "surrogatepass"))
            return known[cid]

        for b in batches:
            x, y, zx, zy = (b.column(i).to_pylist() for i in range(4))
            yes = pa.array([alike(of(p, a), of(q, c), percent) for p, q, a, c in zip(x, y, zx, zy)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(yes), b.column(1).filter(yes)], names=["x", "y"])

    texts = texts.select("cid", "z")
    with_y = pairs.select("x", "y").join(texts.toDF("y", "zy"), "y")
    both = with_y.join(texts.toDF("x", "zx"), "x")
    return both.select("x", "y", "zx", "zy").mapInArrow(run, "x long, y long")


#: Classes of a shingle up to which pairs are joined row by row, and classes of a block beyond.
JOINED, BLOCK_ROWS = 64, 1000


def _in_blocks(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(x, y, l): pairs in different components for shingles with many classes, by comparing blocks of signatures.

    Rows have token, k, cid, n, l, lead, comp and sig. A shingle's classes are
    dealt to blocks of bounded size, and every two blocks meet in one group:
    no pair becomes a row unless its signatures are near enough.
    """
    blocks = F.ceil(F.col("k") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "cid", "n", "l", "lead", "comp", "sig")

    def run(key, t):
        cid, n, l, lead, comp, own = (t[c].to_numpy() for c in ("cid", "n", "l", "lead", "comp", "own"))
        sigs = [np.frombuffer(x, np.uint64) for x in t["sig"].to_pylist()]
        widths = np.array([len(x) for x in sigs])
        found: list[list] = [[], [], []]
        for wide in np.unique(widths):
            for narrow in np.unique(widths[widths <= wide]):
                big, small = np.flatnonzero(widths == wide), np.flatnonzero(widths == narrow)
                p, q = _folded(np.stack([sigs[i] for i in big]), narrow), np.stack([sigs[i] for i in small])
                step = max(1, (1 << 20) // (len(small) * int(narrow)))
                for s in range(0, len(big), step):
                    i, j = big[s : s + step, None], small[None, :]
                    ok = np.bitwise_count(p[s : s + step, None, :] ^ q[None]).sum(2, dtype=np.int64) <= most_apart(n[i].astype(np.int64), n[j], percent)
                    ok &= (comp[i] != comp[j]) & ((n[i] < n[j]) & (lead[i] > 0) | (n[j] < n[i]) & (lead[j] > 0) | (n[i] == n[j]) & (lead[i] > 0) & (lead[j] > 0))
                    ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                    if key[1].as_py() != key[2].as_py():
                        ok &= own[i] != own[j]
                    if wide == narrow:
                        ok &= cid[i] < cid[j]
                    a, b = np.nonzero(ok)
                    a, b = big[s + a], small[b]
                    first = (n[a] < n[b]) | (n[a] == n[b]) & (cid[a] < cid[b])
                    found[0].append(np.where(first, cid[a], cid[b]))
                    found[1].append(np.where(first, cid[b], cid[a]))
                    found[2].append(np.minimum(l[a], l[b]))
        x, y, z = (np.concatenate(f) for f in found)
        return pa.table({"x": x.astype(np.int64), "y": y.astype(np.int64), "l": z.astype(np.int32)})

    return dealt.groupBy("token", "a", "b").applyInArrow(run, "x long, y long, l int")


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(cid, comp) of every class with a link: comp is the smallest class of its component.

    Alternating large and small stars; every step is a minimum per key and a
    join, so no neighbourhood is ever gathered in one row.
    """
    e = edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct()
    e = materialise(e, "stars", files)
    while True:
        # Done when all are stars: nothing hangs on two, and nothing that something hangs on hangs itself.
        once = e.select(F.col("a").alias("v"), F.lit(1).alias("k")).union(e.select(F.col("b").alias("v"), F.lit(0).alias("k")))
        if once.groupBy("v").agg(F.sum("k").alias("hangs"), F.min("k").alias("low")).where("hangs > 1 or (hangs = 1 and low = 0)").isEmpty():
            return e.select(F.col("a").alias("cid"), F.col("b").alias("comp"))
        ways = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = materialise(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "stars", files)


def _close(n: str, m: str, percent: int = PERCENT):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _links(postings: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(cid, comp) of all linked classes, or None where no shingle is shared."""
    edges = tested = comp = None
    # As many files as the rows call for, so that short tables don't cost a task for every partition of the session.
    files = max(1, min(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), postings.count() // FILE_ROWS + 1))
    for turn in range(ROUNDS + 1):
        if comp is None:
            own = postings.withColumn("comp", F.col("cid"))
        else:
            own = postings.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        # Of near copies, those that were changed least have most that is common: they make the best hubs.
        # A little chance in the order gives others each time.
        chance = 1 - F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(1000)) / 4000.0
        own = own.withColumn("order", -(F.col("share") + 1) * chance)
        # Shingles whose classes are in several components; the rest can give no new link.
        each = own.groupBy("token", "comp").agg(F.count("*").alias("k"), F.min(F.struct("order", "cid", "n", "comp")).alias("first"))
        mixed = each.groupBy("token").agg(F.min("first").alias("hub"), F.min("comp").alias("bottom"), F.max("comp").alias("top"), F.sum("k").alias("k"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk")).where(F.col("bottom") < F.col("top"))
        mixed = materialise(mixed, "mixed", files)
        rows, pairs = mixed.agg(F.sum("k"), F.sum((F.col("k").cast("double") * F.col("k") - F.col("kk")) / 2)).first()
        if not rows:
            return comp
        last = turn == ROUNDS or (turn > 0 and (pairs <= PAYS * rows or gained < GAIN))
        if last:
            own = own.join(mixed.select("token", "k"), "token")
            own = materialise(own.select("token", "k", "cid", "n", "l", "lead", "comp"), "mixed-rows", files)
            few = own.where(F.col("k") <= JOINED)
            # The smaller set of a pair needs its lead only.
            one = few.where("lead = 1").select("token", "comp", F.col("cid").alias("x"), "n", "l")
            two = few.select("token", F.col("comp").alias("comp2"), F.col("cid").alias("y"), F.col("n").alias("n2"), F.col("l").alias("l2"), "lead")
            up = "comp <> comp2 and (n < n2 or (n = n2 and x < y and lead = 1))"
            joined = one.join(two, "token").where(_close("n", "n2") & F.expr(up)).select("x", "y", F.least("l", "l2").alias("l"))
            many = own.where(F.col("k") > JOINED).join(texts.select("cid", "sig"), "cid")
            found = joined.union(_in_blocks(many)).groupBy("x", "y").agg(F.count("*").alias("k"), F.first("l").alias("l")).where("k >= l").select("x", "y")
            found = found.join(tested.union(tested.select(F.col("y").alias("x"), F.col("x").alias("y"))), ["x", "y"], "left_anti") if tested is not None else found
        else:
            hubs = mixed.select("token", F.col("hub.comp").alias("hub_comp"), F.col("hub.cid").alias("y"), F.col("hub.n").alias("n2"))
            near = own.join(hubs, "token").where((F.col("comp") != F.col("hub_comp")) & _close("n", "n2")).groupBy(F.col("cid").alias("x"), "y").agg(F.count("*").alias("k"))
            near = near.join(tested, ["x", "y"], "left_anti") if tested is not None else near
            best = Window.partitionBy("x").orderBy(F.desc("k"), "y")
            found = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= HUBS).select("x", "y")
        found = materialise(found, "candidates", files)
        new = materialise(_verify(_plausible(found, texts), texts), "links", files)
        gained = new.count() / max(1, found.count())
        tested = found if tested is None else tested.union(found)
        edges = new if edges is None else edges.union(new)
        if gained:
            comp = components(edges, files)
        if last:
            return comp
    return comp


def class_components(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, cid, n), (cid, component_id, keeper: the class that holds the component's smallest doc_id)."""
    docs = documents_of(documents)
    rows = _classes(docs, BITS)
    counts = _sketch(rows, BITS)
    rows = rows.where("n is not null").select("doc_id", "cid", "n")
    postings = _postings(docs, counts)
    comp = None if postings.isEmpty() else _links(postings, _texts(docs, postings))
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("low"))
    if comp is None:
        return rows, classes.select("cid", F.col("low").alias("component_id"), F.col("cid").alias("keeper"))
    classes = classes.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    # Nulls sort last: a null doc_id keeps a component only where there is no other.
    least = classes.groupBy("comp").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "cid")).alias("m"))
    return rows, classes.join(least, "comp").select("cid", F.col("m.low").alias("component_id"), F.col("m.cid").alias("keeper"))


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, classes = class_components(documents)
    return rows.join(classes, "cid", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def unused(df: DataFrame, name: str) -> str:
    """The name, made longer until the table has no such column (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each component, columns as they are; rows without words all stay.

    The row with the smallest doc_id stays; of several with that id the one
    whose text has the smallest 128-bit hash, and of rows with equal texts the
    first by a hash of the other columns. Columns of any other name are kept.
    """
    _, classes = class_components(documents)
    cid, low, text = (unused(documents, n) for n in ("keep_cid", "keep_low", "keep_text"))
    keepers = classes.where(F.col("cid") == F.col("keeper")).select(F.col("cid").alias(cid), F.coalesce("component_id", F.lit(-(2**63))).alias(low))
    schema = documents.schema
    added = StructType([*schema, StructField(cid, LongType()), StructField(low, LongType()), StructField(text, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            sets = [shingles(t) for t in texts]
            ids = [-(2**63) if d is None else d for d in b.column(b.schema.get_field_index("doc_id")).to_pylist()]
            extra = pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array([exact_key(t) if len(s) else None for t, s in zip(texts, sets)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, cid, low, text])

    rows = in_small_batches(documents).mapInArrow(run, added)
    kept = rows.where(F.col(cid).isNotNull()).join(keepers, [cid, low], "left_semi")
    # Rows of one id and class: one group a document that stays, cut to its first row in each task before it moves.
    others = [F.col(f"`{f.name}`") for f in schema if f.name != "text" and not _has_map(f.dataType)]
    nth = unused(rows, "keep_nth")
    first = F.row_number().over(Window.partitionBy(cid, low).orderBy(text, F.xxhash64(*others)))
    kept = kept.withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
    return kept.select(*rows.columns).unionByName(rows.where(F.col(cid).isNull())).select(*[F.col(f"`{f.name}`") for f in schema])


def _has_map(kind) -> bool:
    return "map<" in kind.simpleString()
