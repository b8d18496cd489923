"""The join against every pair, on random near copies and awkward rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quantgrove.llm import jaccard

from .conftest import SCHEMA, TEXTS


def brute(rows):
    """[(doc_id, n, component_id)] by comparing all pairs of exact shingle sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return sorted(map(str, out))


def joined(df):
    return sorted(str(tuple(r)) for r in jaccard.near_copies(df).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_awkward_rows(request, table):
    assert joined(request.getfixturevalue(table)) == brute(TEXTS)


def near(seed, groups=6, copies=12, words=90):
    """Groups of copies with a few to many words changed, around the threshold, beside a passage that all share."""
    rng, rows = random.Random(seed), []
    passage = " ".join(f"common{i}" for i in range(30))
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.randint(20, words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(w[: rng.randint(int(len(w) * 0.85), len(w))]) + (" " + passage if rng.random() < 0.5 else ""))
    rng.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_near_copies(spark, seed):
    rows = near(seed)
    assert joined(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)) == brute(rows)


def test_block_and_hub_paths(spark, monkeypatch):
    """With the bounds lowered, hot shingles go through blocks and hub rounds repeat."""
    monkeypatch.setattr(jaccard, "JOINED", 3)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jaccard, "PAYS", 0)
    monkeypatch.setattr(jaccard, "GAIN", 0.0)
    rows = near(3, groups=3, copies=20)
    assert joined(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)) == brute(rows)


def test_prefixes_of_linked_sets_share_enough():
    import numpy as np

    rng = np.random.default_rng(4)
    counts = rng.integers(0, 400, 1 << jaccard.BITS)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, len(a) // 7 + 1))
        b = np.unique(np.concatenate([a[: len(a) - drop], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 7 + 1))).astype(np.uint64)]))
        if not len(b) or not jaccard.alike(a, b):
            continue
        (pa, _, la, l1), (pb, _, lb, l2) = (jaccard.prefix(s, counts, 10.0) for s in (a, b))
        small, large = ((pa, la), pb) if len(a) <= len(b) else ((pb, lb), pa)
        assert len(np.intersect1d(small[0][small[1]], large)) >= min(l1, l2)
        x, y = (np.frombuffer(jaccard.signature(s), np.uint64) for s in (a, b))
        w = min(len(x), len(y))
        assert int(np.bitwise_count(jaccard._folded(x, w) ^ jaccard._folded(y, w)).sum()) <= jaccard.most_apart(len(a), len(b))


def test_empty_table(none):
    assert jaccard.near_copies(none).count() == 0 and jaccard.keep_one(none).count() == 0


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_one_of_each_group_stays(request, table):
    df = request.getfixturevalue(table)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    want = [(i, t) for i, t in TEXTS if not (t or "").strip()]
    want += [(1, dict(TEXTS)[1]), (None, "a row without an id"), (8, "one"), (10, dict(TEXTS)[10]), (12, dict(TEXTS)[12]), (13, "two words"), (14, "a b c d e"), (16, "another text with the same id as a copy"), (17, dict(TEXTS)[17])]
    assert got == sorted(map(str, want))


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 201), (201, 200)]
    got = {r["cid"]: r["comp"] for r in jaccard.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 9)} | {201: 200}


def test_reserved_names_and_ties(spark):
    """Columns named like the stage's own, and rows that differ in case or in other columns only."""
    rows = [(1, "A b c d e f", i, 7, 3) for i in (2, 1)] + [(1, "a b c d e f", 0, 7, 3), (2, "a b c d e f", 5, 7, 3), (3, "x", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_cid long, keep_low long, KEEP_NTH long")
    one = [tuple(r) for r in jaccard.keep_one(df).orderBy("doc_id").collect()]
    again = [tuple(r) for r in jaccard.keep_one(df.orderBy(F.desc("keep_cid"))).orderBy("doc_id").collect()]
    assert one == again and [r[0] for r in one] == [1, 3] and jaccard.keep_one(df).columns == df.columns
    named = spark.createDataFrame([(1, "a b", 1, 2, 3)], "doc_id long, text string, __cid long, __low long, __nth long")
    assert [tuple(r) for r in jaccard.keep_one(named).collect()] == [(1, "a b", 1, 2, 3)]


def test_links_of_whole_table_against_every_pair(spark):
    """Documents whose id 50 divides, against all rows: each brute-force link lies in one component."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(docs).collect()}
    rows = [(r["doc_id"], jaccard.shingles(r["text"] or "")) for r in docs.collect()]
    sizes = np.array([len(s) for _, s in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    flat = np.concatenate([s for _, s in rows])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    links = 0
    for d, s in rows:
        assert got[d][0] == len(s)
        if d % 50 or not len(s):
            continue
        low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        shared = np.bincount(np.concatenate([owner[a:z] for a, z in zip(low, high)]), minlength=len(rows))
        for j in np.flatnonzero((shared > 0) & (100 * shared >= 75 * (len(s) + sizes - shared))):
            links += rows[j][0] != d
            assert got[rows[j][0]][1] == got[d][1]
    assert links > 50
