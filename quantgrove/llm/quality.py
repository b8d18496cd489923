"""Document quality from a linear-chain conditional random field over lines.

Every line of a text gets one of two labels, good or bad. Its features are
measures of its own make-up and those of the lines before and after it; the
chain adds how labels follow each other. Forward-backward gives each line's
marginal probability of being good, and a document's quality is their mean
weighted by line length.

The chain is trained by maximum likelihood (numpy, Adam) on lines that inherit
their document's label, from a bounded sample (``most`` labelled documents
outside the held-out fold, by hash of id, one of each distinct text by a 128-bit hash; in
training, and there only, chains are cut after ``chain`` lines). Scoring runs
over whole texts.

Defined results: a null or empty text is one empty line, and its score is that
line's marginal; without labels of both kinds every score is the share of good
labels (1 without any). Rows with a null doc_id are scored but not learnt
from. Of labels of an id that occurs several times the largest counts. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrove.llm.common import batch_of, documents_of, exact_key, held_out, in_small_batches, sample_by_hash

#: Labelled documents of the sample, lines of a training chain, score from which a text is good.
MOST, CHAIN, THRESHOLD = 8000, 64, 0.7

#: Code points that are told apart; those beyond are ideographs, which count as letters.
KNOWN = 0x20000
#: Fixed list: sentence marks, of other scripts too.
MARKS = ".,;:'\"?-()¿¡…‘’“”„«»–—、。，．：；？（）「」『』۔،؛؟।॥"


def _classes() -> np.ndarray:
    """Class of each code point: 0 letter, 1 upper case, 2 digit, 3 white space, 4 sentence mark, 5 bar, 6 other sign."""
    out = np.zeros(KNOWN + 1, np.uint8)
    for c in range(KNOWN):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ch.isupper()
        elif unicodedata.category(ch)[0] != "M":  # marks that belong to letters count as letters
            out[c] = 2 if ch.isdigit() else 3 if ch.isspace() else 4 if ch in MARKS else 5 if ch == "|" else 6
    return out


_CLASS = _classes()
#: Measures of a line.
OWN = 12


def measures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN measures, length of each line)."""
    lines = text.split("\n")
    n = len(lines)
    codes = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    classes = _CLASS[np.minimum(codes, KNOWN)]
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - starts
    size = np.maximum(lengths, 1)
    out = np.zeros((n, OWN))
    for j, c in enumerate((1, 2, 4, 5, 6)):
        out[:, j] = np.add.reduceat(classes == c, starts, dtype=np.int64) / size
    same = Counter(lines)
    for i, line in enumerate(lines):
        ws = line.split()
        k = len(ws)
        if not k:
            out[i, 11] = 1.0
            continue
        out[i, 5] = sum(map(eq, ws, ws[1:])) / k  # a word right after itself
        out[i, 6] = 1 - len(set(ws)) / k  # words said before
        out[i, 7] = np.log1p(k) / 5
        out[i, 8] = min(lengths[i] / k, 30) / 10
        out[i, 9] = same[line] > 1
        out[i, 10] = line[-1] in ".!?"
    return out, lengths


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Own, previous and next measures, edge marks and a constant, per line; lengths."""
    own, lengths = measures(text)
    gap = np.zeros((1, OWN))
    edge = np.zeros((len(own), 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([own, np.vstack([gap, own[:-1]]), np.vstack([own[1:], gap]), edge, np.ones((len(own), 1))]), lengths


WIDTH = 3 * OWN + 3


@dataclass
class Model:
    """Score of label good per feature, scores of label pairs (bad, good in order of the line before)."""

    weights: np.ndarray
    pairs: np.ndarray
    constant: float | None = None


def marginals(scores: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, both: bool = False):
    """P(good) of every line of several chains laid end to end; with ``both`` also the expected pairs and log Z.

    ``scores`` are those of label good (bad has 0). Chains advance together,
    longest first, so the loop is over places, not over lines.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    most = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(1, most + 1), side="right")
    t = np.exp(pairs - pairs.max())
    local = np.stack([np.exp(-np.maximum(scores, 0)), np.exp(np.minimum(scores, 0))], 1)  # scaled to a larger value of 1
    forward, backward = np.empty_like(local), np.ones_like(local)
    logs = np.zeros(len(sizes))
    a = None
    for k in range(most):
        at = starts[: active[k]] + k
        a = local[at] if a is None else (a[: active[k]] @ t) * local[at]
        z = a.sum(1, keepdims=True)
        a = a / z
        forward[at] = a
        logs[: active[k]] += np.log(z[:, 0])
    b = None
    for k in range(most - 2, -1, -1):
        at = starts[: active[k + 1]] + k
        nxt = backward[at + 1] * local[at + 1]
        b = nxt @ t.T
        backward[at] = b / b.sum(1, keepdims=True)
    joint = forward * backward
    good = joint[:, 1] / joint.sum(1)
    if not both:
        return good
    expected = np.zeros((2, 2))
    inner = np.ones(len(scores), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    e = forward[at - 1][:, :, None] * t[None] * (backward[at] * local[at])[:, None, :]
    expected = (e / e.sum((1, 2), keepdims=True)).sum(0) if len(at) else expected
    return good, expected, logs


def train(chains: list[np.ndarray], labels: list[int], steps: int = 250, rate: float = 0.05, shrink: float = 1e-3, chain: int = CHAIN) -> Model:
    """Fit on the feature rows of each document and its label."""
    if not chains or len(set(labels)) < 2:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), float(np.mean(labels)) if labels else 1.0)
    cut, y = [], []
    weight = []
    for x, label in zip(chains, labels):
        for i in range(0, len(x), chain):
            cut.append(x[i : i + chain])
            y.append(label)
            weight.append(min(chain, len(x)) / len(x))  # a document counts as one chain, however long
    x, lengths, y, weight = np.vstack(cut), np.array([len(c) for c in cut]), np.array(y), np.array(weight)
    line, line_weight = np.repeat(y, lengths), np.repeat(weight, lengths)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lengths) - lengths] = False
    n = len(chains)
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    w1 = line_weight[inner]
    seen = np.array([[w1[line[inner] == 0].sum(), 0], [0, w1[line[inner] == 1].sum()]])
    for t in range(1, steps + 1):
        pairs = theta[WIDTH:].reshape(2, 2)
        good, expected, _ = marginals(x @ theta[:WIDTH], lengths, pairs, True)
        scale = seen.sum() / max(expected.sum(), 1e-9)
        slope = np.concatenate([x.T @ ((good - line) * line_weight), (expected * scale - seen).ravel()]) / n + shrink * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def quality_of(texts: list[str], model: Model) -> list[float]:
    """Length-weighted mean marginal of each text."""
    if model.constant is not None or not texts:
        return [model.constant] * len(texts)
    each = [features(t) for t in texts]
    lengths = np.array([len(x) for x, _ in each])
    good = marginals(np.concatenate([x @ model.weights for x, _ in each]), lengths, model.pairs)
    out, at = [], 0
    for x, size in each:
        own = good[at : at + len(x)]
        at += len(x)
        out.append(float(own @ size / size.sum()) if size.sum() else float(own.mean()))
    return [min(1.0, max(0.0, s)) for s in out]


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    spark = documents.sparkSession
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(usable & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = sample_by_hash(marks, "doc_id", most).collect()
    if not rows:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 1.0)
    chosen = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, quality int")  # at most ``most`` rows
    out = pa.schema([("text", pa.binary()), ("quality", pa.int32()), ("lines", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield batch_of(out, {"text": [exact_key(text)], "quality": [label], "lines": [measures(text)[0].astype("<f4").tobytes()]})

    got = documents_of(documents).join(F.broadcast(chosen), "doc_id").select("quality", "text").mapInArrow(run, "text binary, quality int, lines binary").dropDuplicates(["text", "quality"]).toArrow().sort_by([("text", "ascending"), ("quality", "ascending")])
    chains = []
    gap = np.zeros((1, OWN))
    for x in got["lines"].to_pylist():
        own = np.frombuffer(x, "<f4").reshape(-1, OWN).astype(float)
        edge = np.zeros((len(own), 2))
        edge[0, 0] = edge[-1, 1] = 1
        chains.append(np.hstack([own, np.vstack([gap, own[:-1]]), np.vstack([own[1:], gap]), edge, np.ones((len(own), 1))]))
    return train(chains, got["quality"].to_pylist())


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every document."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, texts = (b.column(i).to_pylist() for i in range(2))
            for i in range(0, len(texts), 500):
                scores = quality_of(texts[i : i + 500], model)
                yield batch_of(out, {"doc_id": doc_ids[i : i + 500], "score": scores, "predicted": [int(s >= threshold) for s in scores]})

    return documents_of(documents).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 500):
                some = b.slice(i, 500)
                texts = some.column(some.schema.get_field_index("text")).to_pylist()
                yield some.filter(pa.array([s >= threshold for s in quality_of([t or "" for t in texts], model)], pa.bool_()))

    return in_small_batches(documents).mapInArrow(run, documents.schema)
