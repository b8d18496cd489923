"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Hosts and rules are matched by DataFrame functions. Where no rule fits, trees
decide: boosted regression trees on the logistic loss (numpy, histogram
splits) over length, depth, digit ratio, entropy, parameter counts, host shape
and suffix statistics. They are trained from labelled URLs: by default those
of the table whose host holds a word of a fixed list of advertising terms
(labelled block) and all others that no rule decides (labelled allow), a
bounded sample by hash. A rule's verdict is no label: it follows from the rule
and not from what the features see. Suffix statistics are the smoothed share of blocked
URLs by top-level name among the labelled ones.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule; its verdict is the trees'. Without labelled URLs of both kinds
the trees give the one label seen, or allow. Columns other than page_id and
url are ignored; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrove.llm.common import batch_of, sample_by_hash

#: (verdict, host, path). A rule fits its host and all subdomains where the path starts with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Fixed list: host words that mark a labelled URL as advertising.
TERMS = ("bets", "casino", "cheap", "deals", "discount", "loan", "lottery", "pills", "poker", "replica", "viagra", "win")
#: Labelled URLs that training takes at most; trees, their depth and step.
MOST, TREES, DEPTH, RATE = 20_000, 60, 3, 0.2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


# --- features -------------------------------------------------------------

NAMES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "longest_label", "query_length", "suffix_share")


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    counts = np.unique(np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def lexical(url: str, host: str, path: str, suffixes: dict[str, float], usual: float) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".")
    return [
        len(url), len(host), len(path), sum(1 for x in path.split("/") if x), sum(c.isdigit() for c in url) / max(1, len(url)),
        _entropy(host), query.count("=") , len(labels), host.count("-"), max(map(len, labels)), len(query), suffixes.get(labels[-1], usual),
    ]


# --- boosted trees --------------------------------------------------------


@dataclass
class Trees:
    """Trees over binned features; each is (feature, edge, left, right, value) rows."""

    base: float = -20.0
    trees: list[list[tuple]] = field(default_factory=list)
    suffixes: dict[str, float] = field(default_factory=dict)
    usual: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for nodes in self.trees:
            at = np.zeros(len(x), int)
            f, e, left, right, value = (np.array(c) for c in zip(*nodes))
            for _ in range(DEPTH):
                go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= e[at]
                at = np.where(f[at] < 0, at, np.where(go, left[at], right[at]))
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = 20, ridge: float = 1.0) -> tuple[float, list[list[tuple]]]:
    """Second-order boosting of the logistic loss with 32 quantile bins a feature."""
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin, made = np.full(len(x), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            k, gs, hs = len(nodes), g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, k, k, -rate * gs / (hs + ridge)])
            best = (1e-6, None, None)
            if level < depth and len(rows) >= 2 * least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = bins[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, i)
            if best[1] is not None:
                _, j, i = best
                to = bins[rows, j] <= i
                left, right = grow(rows[to], level + 1), grow(rows[~to], level + 1)
                nodes[k][:4] = [j, float(edges[j][i]), left, right]
            else:
                margin[rows] += nodes[k][4]
            return k

        grow(np.arange(len(x)), 0)
        made.append([tuple(n) for n in nodes])
    return base, made


def fit(labelled: DataFrame, most: int = MOST) -> Trees:
    """Train on (url, label) rows, label 1 for block; at most ``most`` distinct URLs, by hash."""
    host, path = host_and_path(F.col("url"))
    known = labelled.where("url is not null and label is not null").groupBy("url").agg(F.max("label").alias("label"))
    rows = sample_by_hash(known, "url", most).select("url", host.alias("host"), path.alias("path"), "label").collect()
    if not rows:
        return Trees()
    y = np.array([r["label"] for r in rows], float)
    usual, by = float(y.mean()), {}
    for r in rows:
        by.setdefault(r["host"].split(".")[-1], []).append(r["label"])
    suffixes = {k: (sum(v) + 10 * usual) / (len(v) + 10) for k, v in by.items()}
    if len(set(y.tolist())) < 2:
        return Trees(20.0 if usual else -20.0, [], suffixes, usual)
    x = np.array([lexical(r["url"], r["host"], r["path"], suffixes, usual) for r in rows])
    return Trees(*boost(x, y), suffixes, usual)


def labelled_by_terms(pages: DataFrame, rules=RULES, terms=TERMS) -> DataFrame:
    """(url, label): block for a host with a word of the list, allow for any other URL without a rule, else null."""
    host, path = host_and_path(F.col("url"))
    _, verdict = fitting_rule(host, path, rules)
    term = host.rlike(rf"(^|[.-])({'|'.join(terms)})([.-]|$)")
    return pages.select("url", F.when(term, F.lit(1)).when(verdict.isNull(), F.lit(0)).alias("label"))


def judge(pages: DataFrame, trees: Trees, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of every row."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page_id, url, h, p, r, v = (b.column(i).to_pylist() for i in range(6))
            if not page_id:
                continue
            x = np.array([lexical(u or "", a, c, trees.suffixes, trees.usual) for u, a, c in zip(url, h, p)])
            s = 1 / (1 + np.exp(-np.clip(trees.margin(x), -60, 60)))
            yield batch_of(out, {"page_id": page_id, "host": h, "path": p, "rule": r, "verdict": [a or ("block" if z >= 0.5 else "allow") for a, z in zip(v, s)], "score": s.tolist()})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "verdict": verdict})
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
