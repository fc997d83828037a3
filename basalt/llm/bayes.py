"""Quality by hierarchical empirical Bayes: a document's own evidence, and the record of its site and path."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .cut import cut, labelled_sample
from .quality import measure_chunk

#: Labelled documents that the document classifier is fitted on, at most: those of the smallest hashes.
MAX_LABELLED = 20_000
#: Sites that are few enough to broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "dup_words", "upper", "digits", "exclaims", "distinct", "short")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a document: FEATURES, all bounded."""
    m = measure_chunk(data, offsets)
    words = tx.Words(data, offsets)
    n, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    share = lambda mask: tx.sums(mask, offsets[:-1], offsets[1:]) / chars
    _, later = tx.repeats(words.hashes ^ tx.mix(words.doc.astype(np.uint64) + np.uint64(1)))
    distinct = 1 - tx.sums(later, words.first[:-1], words.first[1:]) / n
    return np.stack([
        np.log1p(m["n_words"]) / 10, np.minimum(chars / n, 20) / 10, np.minimum(m["n_symbols"] / n, 3), m["dup_line_chars"] / chars, m["n_repeat_words"] / n,
        share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), np.minimum(tx.sums(data == 33, offsets[:-1], offsets[1:]) / n, 3), distinct, m["n_words"] < 10,
    ], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method on standardised features; weights for raw ones, the constant last."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return np.append(np.zeros(len(FEATURES)), np.log(rate / (1 - rate)))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / spread, np.ones(len(y))))
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge * len(y)), 0)
    for _ in range(rounds):
        # einsum, not BLAS: its threads may hang in a process that has started a JVM.
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", z, w), -30, 30)))
        hessian = np.einsum("ki,kj->ij", z * (p * (1 - p) + 1e-9)[:, None], z) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, np.einsum("ki,k->i", z, y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def shrunk(good: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (good + strength * prior) / (n + strength)


def strength_of(prior: str) -> Column:
    """The Beta prior's strength by the method of moments: how much groups' rates vary beyond their sampling noise."""
    mean = F.sum("good") / F.sum("n")
    noise = F.sum(F.col(prior) * (1 - F.col(prior)))
    between = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(prior), 2)) - noise
    scale = F.sum("n") - F.sum(F.pow("n", F.lit(2))) / F.sum("n")
    variance = between / F.when(scale > 0, scale)
    ratio = mean * (1 - mean) / F.when(variance > 0, variance) - 1
    # No variance beyond noise: groups are nearly alike, and count for little.
    return F.least(F.greatest(F.coalesce(ratio, F.lit(1e6)), F.lit(1.0)), F.lit(1e6))


def quality_posterior(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality",
    max_labelled: int = MAX_LABELLED, threshold: float = 0.5,
) -> DataFrame:
    """(key, p_document, p_host, p_path, score, kept): one row for each row of docs.

    A ridge logistic classifier, fitted on at most ``max_labelled`` labelled
    documents, gives each document's evidence. Labels, and for unlabelled
    documents that evidence, are summed by host and by path within a host.
    Hosts shrink toward the global rate and paths toward their host's, by Beta
    priors whose strengths come from the spread between groups, so a sparse
    site says little. p_host and p_path leave the document's own label or
    evidence out, so that it does not count twice. score adds what the path's
    posterior says beyond the global rate to the document's own log odds; kept
    is score >= threshold.

    Labels: rows with a null key or label are ignored, of repeated ones the
    largest label counts. Null hosts and paths are groups of their own. Null
    texts count as empty, texts of any length are measured whole; keys pass as
    they are, null and repeated ones too. Without any labels the classifier says
    0.5. Other columns are not read; an empty table gives no rows. Sums are
    combined before they are shuffled; the table of sites is broadcast if it has
    at most MOST_BROADCAST rows, else joined.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"))
    fields = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])

    def measure(column):
        rows = [features(data, offsets) for _, _, data, offsets in tx.chunks(column)]
        return [np.concatenate(rows).tolist() if rows else []], None

    seen = cut(tx.map_columns(narrow, "text", fields, measure).drop("text"))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("double").alias("label"))
    joined = seen.join(known, "key", "left")
    sample = labelled_sample(joined.where("label IS NOT NULL").select(F.xxhash64("key").alias("_h"), "key", "x", "label"), max_labelled)
    weights = logistic(np.array([r["x"] for r in sample]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in sample]))
    odds = sum((F.lit(float(w)) * F.col("x")[i] for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    judged = joined.withColumn("odds", F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))).withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    judged = cut(judged.select("key", "host", "path", "odds", "p", F.coalesce("label", "p").alias("y")))

    paths = cut(judged.groupBy("host", "path").agg(F.sum("y").alias("good"), F.count("*").cast("double").alias("n")))
    hosts = cut(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    # Three numbers reach the driver: the global rate and the strengths.
    rate = hosts.agg(F.sum("good") / F.sum("n")).first()[0]
    prior = F.lit(0.5 if rate is None else float(rate))
    of_host = F.lit(float(hosts.withColumn("rate", prior).agg(strength_of("rate")).first()[0]))
    hosts = hosts.withColumn("p", shrunk(F.col("good"), F.col("n"), prior, of_host)).select(F.col("host").alias("h"), "p", F.struct("good", "n").alias("of_host"))
    inner = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"))
    of_path = F.lit(float(inner.agg(strength_of("p")).first()[0]))
    sites = inner.select(F.col("host").alias("h"), F.col("path").alias("s"), "of_host", F.struct("good", "n").alias("of_path"))
    if sites.count() <= MOST_BROADCAST:
        sites = F.broadcast(sites)

    log_odds = lambda c: F.log(F.greatest(c, F.lit(1e-9)) / F.greatest(1 - c, F.lit(1e-9)))
    out = judged.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("s")), "left")
    # Its own evidence is left out of what its host and path say.
    others = lambda c: (F.col(f"{c}.good") - F.col("y"), F.col(f"{c}.n") - 1)
    out = out.withColumn("p_host", shrunk(*others("of_host"), prior, of_host))
    out = out.withColumn("p_path", shrunk(*others("of_path"), F.col("p_host"), of_path))
    score = 1 / (1 + F.exp(-(F.col("odds") + log_odds(F.col("p_path")) - log_odds(prior))))
    return out.select(F.col("key").alias(key), F.col("p").alias("p_document"), "p_host", "p_path", score.alias("score"), (score >= threshold).alias("kept"))
