"""URL filters: rules by host and path; gradient-boosted trees on lexical features for what no rule judges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cut import cut, labelled_sample

#: Labelled URLs that the trees are fitted on, at most: those of the smallest hashes.
MAX_LABELLED = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, text: str) -> Rule:
        verdict, where = text.split(" ", 1)
        host, slash, path = where.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for null or without ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


#: What the suffix statistics are kept by: the last label of the host, its last two, the first path segment, and the
#: last label with the first segment and the first character of the second.
GROUPS = ("suffix", "site", "head", "branch")
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "labels", "host_length", "path_length", "hyphens", *(f"{g}_rate" for g in GROUPS))
LEXICAL = len(FEATURES) - len(GROUPS)
#: Labels of the base rate that every group's rate begins from.
WEIGHT = 5.0
#: Groups of one kind that are few enough to broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def group_columns(host: Column, path: Column) -> list[Column]:
    suffix = F.substring_index(host, ".", -1)
    head, branch = (F.regexp_extract(path, pattern, 1) for pattern in ("^/([^/]*)", "^/([^/]*/[^/]?)"))
    return [suffix, F.substring_index(host, ".", -2), head, F.concat_ws("/", suffix, branch)]


def lexical(urls: Sequence[str], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    out = np.zeros((len(urls), LEXICAL))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        raw = np.frombuffer(url.encode(), np.uint8)
        share = np.bincount(raw)
        share = share[share > 0] / max(len(raw), 1)
        query = url.partition("?")[2].partition("#")[0]
        digits = int(((raw >= 48) & (raw <= 57)).sum())
        out[i] = (
            len(url), sum(bool(p) for p in path.split("/")), digits / max(len(raw), 1), -(share * np.log2(share)).sum() if len(share) else 0.0,
            sum(bool(p) for p in query.split("&")), host.count(".") + 1, len(host), len(path), url.count("-"),
        )
    return out


def rates(blocked: np.ndarray, total: np.ndarray, base: float) -> np.ndarray:
    """Shrunken rates, one column a kind of group."""
    return (blocked + WEIGHT * base) / (total + WEIGHT)


class BoostedTrees:
    """Gradient boosting of small regression trees for the log loss, on quantile bins."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(mean / (1 - mean)))
        score, self.trees = np.full(len(y), self.start), []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            # Heap order: node k has the children 2k + 1 and 2k + 2; a leaf's feature is -1.
            feature, cut, value = (np.full(2 ** (self.depth + 1) - 1, v) for v in (-1, 0, 0.0))
            node = np.zeros(len(y), np.int64)
            for k in range(len(feature)):
                rows = np.flatnonzero(node == k)
                g, h = gradient[rows].sum(), weight[rows].sum()
                value[k] = self.rate * g / (h + self.ridge)
                if not len(rows) or k >= 2**self.depth - 1:
                    continue
                best = (1e-9, -1, 0)
                for f in range(x.shape[1]):
                    left_g = np.cumsum(np.bincount(binned[rows, f], gradient[rows], len(self.cuts[f]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, f], weight[rows], len(self.cuts[f]) + 1))[:-1]
                    if len(left_g):
                        gain = left_g**2 / (left_h + self.ridge) + (g - left_g) ** 2 / (h - left_h + self.ridge) - g**2 / (h + self.ridge)
                        if gain.max() > best[0]:
                            best = (float(gain.max()), f, int(gain.argmax()))
                if best[1] >= 0:
                    feature[k], cut[k] = best[1:]
                    node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[2])
            self.trees.append((feature, cut, value))
            score += value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                below = 2 * node + 1 + (binned[np.arange(len(x)), np.maximum(f, 0)] > cut[node])
                node = np.where(f >= 0, below, node)
            score += value[node]
        return 1 / (1 + np.exp(-score))


class UrlModel:
    """Trees over lexical features and suffix statistics, fitted on labelled URLs.

    ``blocked`` and ``total`` hold the labels by group, over all labelled rows;
    each URL's own ``copies`` are left out of them, so that no label predicts itself.
    """

    def __init__(self, urls: list[str], hosts: list[str], paths: list[str], y: np.ndarray, copies: np.ndarray, blocked: np.ndarray, total: np.ndarray, base: float):
        self.base = base
        self.trees = None
        if 0 < y.sum() < len(y):
            own = rates(blocked - (copies * y)[:, None], total - copies[:, None], base)
            self.trees = BoostedTrees().fit(np.column_stack((lexical(urls, hosts, paths), own)), y)

    def score(self, urls: list[str], hosts: list[str], paths: list[str], blocked: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The probability of ``block``; without both kinds of labels, their mean."""
        if self.trees is None or not urls:
            return np.full(len(urls), self.base)
        return self.trees.predict(np.column_stack((lexical(urls, hosts, paths), rates(blocked, total, self.base))))


def filter_urls(pages: DataFrame, rules: Sequence[str], url: str = "url", max_labelled: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """Every row of pages with host, path, rule, verdict and score.

    A rule ``block com/en/`` fits the host, all its subdomains and paths that
    begin with its path; of several the longest wins, of equal ones the first
    by name. URLs that a rule judges are the labelled ones, from which
    ``learned_verdicts`` judges the others.

    Null URLs and those without ``://`` have an empty host and path, fit no
    rule and are scored as they are (null as empty). URLs of any length are
    taken whole. With no labelled URL, all are allowed. Repeated rows are judged
    alike, each on its own row. Columns of pages named like a new one are
    replaced; others pass unchanged. An empty table gives no rows.
    """
    parsed = sorted(map(Rule.parse, rules), key=lambda r: (-len(r.name), r.name))
    host, path = url_parts(F.col(url))
    new = ("host", "path", "rule", "verdict", "score")
    out = pages.select(*[c for c in pages.columns if c not in new or c == url], host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(parsed):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return learned_verdicts(out.withColumns({"rule": rule, "verdict": verdict}), url, max_labelled, threshold)


def learned_verdicts(rows: DataFrame, url: str = "url", max_labelled: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """rows of url, host and path with the null verdicts filled in, and the score of those (else null).

    Labels are counted by GROUPS over all labelled rows. The trees are fitted on
    the driver, on at most ``max_labelled`` distinct labelled URLs, those of the
    smallest hashes. A URL is blocked if its score passes ``threshold``. Tables of at
    most MOST_BROADCAST groups are broadcast to the rows, larger ones joined.
    """
    kinds = group_columns(F.col("host"), F.col("path"))
    labelled = rows.where("verdict IS NOT NULL")
    blocked = (F.col("verdict") == "block").cast("long")
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), g.alias("name")) for k, g in enumerate(kinds))))
    counts = cut(labelled.select(blocked.alias("y"), pairs.alias("g")).groupBy("g.kind", "g.name").agg(F.sum("y").alias("b"), F.count("*").alias("n")))
    sizes = {r["kind"]: r for r in counts.groupBy("kind").agg(F.count("*").alias("groups"), F.sum("b").alias("b"), F.sum("n").alias("n")).collect()}
    base = sizes[0]["b"] / sizes[0]["n"] if sizes else 0.0

    def with_counts(df: DataFrame) -> DataFrame:
        for k, g in enumerate(group_columns(F.col("host"), F.col("path"))):
            of = counts.where(F.col("kind") == k).select(F.col("name").alias(f"_g{k}"), F.col("b").alias(f"_b{k}"), F.col("n").alias(f"_n{k}"))
            few = not sizes or sizes[k]["groups"] <= MOST_BROADCAST
            df = df.withColumn(f"_g{k}", g).join(F.broadcast(of) if few else of, f"_g{k}", "left").drop(f"_g{k}")
        return df

    counted = [f"_{c}{k}" for c in "bn" for k in range(len(GROUPS))]
    # One row a URL: a URL of many rows fills no sample.
    single = labelled.groupBy(F.col(url).alias("url"), "host", "path").agg(F.max(blocked.cast("double")).alias("y"), F.count("*").alias("copies"))
    sample = labelled_sample(single.withColumn("_h", F.xxhash64("url")).select("_h", "url", "host", "path", "y", "copies"), max_labelled)
    shape = "_h long, url string, host string, path string, y double, copies long"
    sample = with_counts(rows.sparkSession.createDataFrame(sample, shape)).orderBy("_h", "url").collect() if sample else []
    column = lambda c: np.array([r[c] or 0 for r in sample], float)
    table = lambda c: np.stack([column(f"_{c}{k}") for k in range(len(GROUPS))], axis=1)
    model = UrlModel(*([r[c] for r in sample] for c in ("url", "host", "path")), column("y"), column("copies"), table("b"), table("n"), base)
    names = rows.columns
    fields = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    at = {c: names.index(c) for c in (url, "host", "path", "verdict")}

    def judge(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = batch.column(at["verdict"]).to_pylist()
            open_ = pa.array([i for i, v in enumerate(verdicts) if v is None], pa.int64())
            u, h, p = (batch.column(at[c]).take(open_).to_pylist() for c in (url, "host", "path"))
            b, n = (np.stack([batch.column(f"_{c}{k}").take(open_).fill_null(0).to_numpy(zero_copy_only=False) for k in range(len(GROUPS))], axis=1) for c in "bn")
            scores: list[float | None] = [None] * len(verdicts)
            for i, s in zip(open_.to_pylist(), model.score([x or "" for x in u], h, p, b, n).tolist(), strict=True):
                scores[i], verdicts[i] = s, "block" if s > threshold else "allow"
            columns = [batch.column(c) for c in names]
            columns[at["verdict"]] = pa.array(verdicts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    return with_counts(rows).select(*names, *counted).mapInArrow(judge, fields)
