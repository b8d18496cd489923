"""Document fingerprints from closed syncmers.

A k-mer of code points is kept when the smallest hash among its inner
substrings of length s lies at its first or last place. Whether a k-mer is
kept depends on its own letters only, so two texts that share a passage keep
the same anchors inside it, whatever surrounds it. A fingerprint is a bottom-m
sample of the distinct kept k-mers, each with the place of its first
occurrence; m is 64, and one for every 256 code points of a longer text.
Likeness compares two samples and counts only anchors that lie in
the same order in both texts.

Defined results: a null text counts as empty; an empty text has the empty
fingerprint, which is like another empty one (1.0) and unlike any other (0.0).
Texts are framed by k-1 end marks on either side, so that texts shorter than k
have anchors by the same rule. Rows with a null doc_id come first in the
order, ties on doc_id go by text. Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrove.llm.common import batch_of, documents_of

#: Code points of a k-mer, of an inner substring, and anchors of a fingerprint.
K, S, SAMPLE = 12, 5, 64
#: Code points of a long text for each anchor: a shared passage of some thousand is seen in a text of any length.
EACH = 256
#: Rows of one output batch.
ROWS = 500
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_ANCHOR = np.dtype([("hash", ">u4"), ("at", ">u4")])

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of the given width, by doubling."""
    whole, at, block, size = None, 0, codes, 1
    while True:
        if width & size:
            if whole is None:
                whole = block
            else:  # what is there so far stands to the left of the next block
                n = len(codes) - at - size + 1
                whole = whole[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + block[at : at + n]
            at += size
        if at == width:
            return whole
        n = len(block) - size
        block = block[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + block[size : size + n]
        size *= 2


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of the given width."""
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every closed syncmer of the framed text, in order of place."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    body = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.zeros(len(body) + 2 * (k - 1), np.uint64)
    codes[k - 1 : k - 1 + len(body)] = body
    codes[k - 1 : k - 1 + len(body)] += np.uint64(1)  # end marks are 0, so U+0000 is not one
    inner = _mix(_windows(codes, s))
    w = k - s + 1
    low = _minima(inner, w)
    n = len(low)
    at = np.flatnonzero((inner[:n] == low) | (inner[w - 1 : w - 1 + n] == low))
    return _mix(_windows(codes, k)[at]), at


def sketch(text: str, k: int = K, s: int = S, sample: int = SAMPLE) -> np.ndarray:
    """The sampled anchors: the smallest hashes of (k-mer, how often it came before), with their places.

    Repeats count, so that a text that says one thing over and over keeps its
    likeness to a version with another end.
    """
    hashes, at = syncmers(text, k, s)
    order = np.argsort(hashes, kind="stable")
    hashes, at = hashes[order], at[order]
    new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    nth = np.arange(len(hashes)) - np.repeat(new, np.diff(np.r_[new, len(hashes)]))
    values = _mix(hashes + nth.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(32)
    values, first = np.unique(values, return_index=True)
    most = min(sample_of(len(text), sample), len(values))
    out = np.zeros(most, _ANCHOR)
    out["hash"] = values[:most]
    out["at"] = at[first[:most]]
    return out


def encode(anchors: np.ndarray) -> str:
    return base64.b64encode(anchors.tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), _ANCHOR)


def likeness(a: np.ndarray, b: np.ndarray, sample: int = SAMPLE) -> float:
    """Share of the joint bottom sample that both hold, in the same order of place.

    A sample smaller than ``sample`` is whole. Of two that are cut, the joint
    sample is as large as the smaller one.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = dict(a.tolist()), dict(b.tolist())
    cut = [n for n in (len(x), len(y)) if n >= sample]
    joint = sorted(x.keys() | y.keys())[: min(cut, default=max(len(x), len(y)))]
    tails: list[int] = []
    for _, at in sorted((x[h], y[h]) for h in joint if h in x and h in y):
        i = bisect_left(tails, at)
        tails[i : i + 1] = [at]
    return len(tails) / len(joint)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many code points (or all) of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def cuts_below(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below the value, by halving: the steps grow with the logarithm of their number."""
    if not cuts:
        return F.lit(0)
    at = F.lit([int(c) for c in cuts])

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        below = F.element_at(at, F.least(middle + 1, F.lit(len(cuts)))) < value
        open_ = a["low"] < a["high"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(a["low"]).alias("low"), F.when(open_ & ~below, middle).otherwise(a["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.lit(list(range(len(cuts).bit_length() + 1))), start, step)["low"]


def sample_of(n_chars: int, sample: int) -> int:
    """Anchors that a text of this length may keep: ``sample``, and one for every ``EACH`` code points of a long one."""
    return max(sample, n_chars // EACH)


def ordered_with_next(docs: DataFrame, splits: int = 1024) -> DataFrame:
    """Rows grouped by ranges of doc_id, each range followed by the first row of the next one.

    Adds ``range`` and ``ahead`` (1 for the added row). Ranges come from one
    thin pass over doc_id (a quantile sketch of bounded size); texts cross the
    network once. The row after the last is the first of all.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    docs = docs.withColumn("ord", key)
    spark = docs.sparkSession
    splits = max(splits, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / splits for i in range(1, splits)]
    n, cuts = docs.agg(F.sum(F.lit(1)), F.percentile_approx("ord", probs, 10 * splits)).first()
    groups = max(1, min(splits, (n or 0) // 256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted(set((cuts or [])[splits // groups - 1 :: max(1, splits // groups)]))
    ranged = docs.withColumn("range", cuts_below(F.col("ord"), cuts))
    firsts = [tuple(r) for r in ranged.groupBy("range").agg(F.min("ord")).orderBy("range").collect()]
    to = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]  # the first of all goes to the last
    ahead = spark.createDataFrame(to or [(0, 0)], "ord long, to int")
    one = F.struct(F.col("range").alias("range"), F.lit(0).alias("ahead"))
    two = F.struct(F.col("to").alias("range"), F.lit(1).alias("ahead"))
    return (
        ranged.join(F.broadcast(ahead), "ord", "left")
        .select("doc_id", "ord", "text", F.explode(F.when(F.col("to").isNull(), F.array(one)).otherwise(F.array(one, two))).alias("x"))
        .select("doc_id", "ord", "text", "x.range", "x.ahead")
        .repartition("range")
        .sortWithinPartitions("range", "ahead", "ord", "text")
    )


def fingerprint(documents: DataFrame, k: int = K, s: int = S, sample: int = SAMPLE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and likeness to that and to the next document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in schema}
        kept, done = None, None

        def put(doc_id, text, own, following, after) -> None:
            changed = edited(text, following)
            other = own if changed == text else sketch(changed, k, s, sample)
            for name, v in (("doc_id", doc_id), ("n_chars", len(text)), ("edited_sha256", hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()), ("fingerprint", encode(own)), ("edited_fingerprint", encode(other)), ("near_edited", likeness(own, other, sample)), ("near_next", likeness(own, after, sample))):
                out[name].append(v)

        for b in batches:
            for doc_id, text, group, ahead in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if ahead and group == done:
                    continue
                own = sketch(text, k, s, sample)
                if kept is not None:
                    put(*kept, text, own)
                kept, done = (None, group) if ahead else ((doc_id, text, own), None)
                if len(out["doc_id"]) >= ROWS:
                    yield batch_of(schema, out)
                    out = {f.name: [] for f in schema}
        if out["doc_id"]:
            yield batch_of(schema, out)

    rows = ordered_with_next(documents_of(documents)).select("doc_id", "text", "range", "ahead")
    return rows.mapInArrow(run, SCHEMA)
