"""Exact top-k by inner product: cover trees of queries and data, searched together block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cut import cut

BLOCK = 2048
LEAF = 32
#: A node is not split if covering it at half its radius takes more centres than this.
FANOUT = 256
#: Blocks of a side that meet as many of the other in one group.
SIDE = 4
#: Of trees' and groups' shuffles; beyond it, a partition holds several.
MOST_PARTITIONS = 1 << 16


class CoverTree:
    """Points under nodes whose covering radius halves from level to level.

    Nodes are rows of arrays, parents before children; a node's points are
    ``order[low:high]``, its covering radius the true one of those points.
    Points that lie too far apart to share children stay a leaf, whatever their
    number: no bound could tell such children apart.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors = vectors
        x = vectors.astype(float)
        order = np.arange(len(x))
        center, low, high, radius, kids = [], [], [], [], []
        todo = [(0, len(x), 0, -1)]
        while todo:
            a, b, mid, parent = todo.pop()
            own = order[a:b]
            far = np.sqrt(((x[own] - x[mid]) ** 2).sum(axis=1))
            node = len(center)
            center.append(mid)
            low.append(a)
            high.append(b)
            radius.append(float(far.max()))
            kids.append([])
            if parent >= 0:
                kids[parent].append(node)
            if b - a <= leaf or radius[-1] == 0:
                continue
            # Children: centres that cover all points within half the radius, the node's own centre first.
            reach, part, heads, free = radius[-1] / 2, np.full(b - a, -1), [], far.copy()
            at = int(far.argmin())
            while at >= 0 and len(heads) <= FANOUT:
                heads.append(int(own[at]))
                d = np.sqrt(((x[own] - x[own[at]]) ** 2).sum(axis=1))
                part[(d <= reach) & (part < 0)] = len(heads) - 1
                free = np.where(part < 0, d, -1.0)
                at = int(free.argmax()) if (part < 0).any() else -1
            if at >= 0:
                continue
            by = np.argsort(part, kind="stable")
            order[a:b] = own[by]
            edges = a + np.searchsorted(part[by], np.arange(len(heads) + 1))
            todo += [(int(edges[i]), int(edges[i + 1]), heads[i], node) for i in range(len(heads))]
        self.order, self.kids = order, kids
        self.low, self.high, self.radius = np.array(low), np.array(high), np.array(radius)
        self.center = x[center]
        self.norm = np.sqrt((self.center**2).sum(axis=1))
        length = np.sqrt((x[order] ** 2).sum(axis=1))
        self.longest = np.array([length[a:b].max() for a, b in zip(low, high, strict=True)])
        self.leaves = np.array(sorted((n for n in range(len(low)) if not kids[n]), key=lambda n: low[n]))

    def leaves_below(self, nodes: np.ndarray) -> np.ndarray:
        starts = self.low[self.leaves]
        a, b = np.searchsorted(starts, self.low[nodes]), np.searchsorted(starts, self.high[nodes])
        return self.leaves[np.concatenate([np.arange(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])] if len(nodes) else self.leaves[:0]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles where no sum can pass 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2.0**53 else a @ b.T


def bounds(queries: CoverTree, q: int, data: CoverTree, nodes: np.ndarray) -> np.ndarray:
    """No inner product of a point under query node q with one under each data node is larger.

    By centres c, d and radii r, s: cd + |c| s + |d| r + r s; and by the longest
    vectors Q, D and the least distance of two points, (Q^2 + D^2 - least^2) / 2.
    """
    c, r, d, s = queries.center[q], queries.radius[q], data.center[nodes], data.radius[nodes]
    dots = np.einsum("ij,j->i", d, c)
    by_radii = dots + queries.norm[q] * s + data.norm[nodes] * r + r * s
    apart = np.sqrt(np.maximum(data.norm[nodes] ** 2 + queries.norm[q] ** 2 - 2 * dots, 0))
    least = np.maximum(apart - r - s - 1e-6 * (1 + apart), 0)
    by_distance = (queries.longest[q] ** 2 + data.longest[nodes] ** 2 - least**2) / 2
    slack = 1e-9 * (queries.norm[q] + r) * (data.norm[nodes] + s) + 1e-6
    return np.minimum(by_radii, by_distance) + slack


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, k: int, best: np.ndarray, names: np.ndarray) -> int:
    """Lower each query's k best so far, (score, id) by rank, by the data's points; returns how many scores were computed.

    ``best`` is -2**62 where there is none yet. A pair of nodes is passed over
    if its bound lies below the worst k-th score of the queries in the node.
    Both sides go down together; a query leaf takes the data's leaves by falling
    bound, in batches that double, and stops where the bounds fall below.
    """
    done = 0
    todo = [(0, np.array([0]))]
    while todo:
        q, nodes = todo.pop()
        rows = queries.order[queries.low[q] : queries.high[q]]
        if not queries.kids[q]:
            nodes = data.leaves_below(nodes)
        bound = bounds(queries, q, data, nodes)
        order = np.argsort(-bound, kind="stable")
        nodes, bound = nodes[order], bound[order]
        nodes = nodes[bound >= best[rows, k - 1].min()]
        if queries.kids[q]:
            below = np.array([c for n in nodes.tolist() for c in (data.kids[n] or [n])], np.int64)
            if len(below):
                todo += [(c, below) for c in queries.kids[q]]
            continue
        bound, batch = bound[: len(nodes)], 4 * LEAF
        while len(nodes):
            sizes = np.cumsum(data.high[nodes] - data.low[nodes])
            n = max(1, int(np.searchsorted(sizes, batch, "right")))
            done += score_leaves(queries, rows, query_ids, data, data_ids, nodes[:n], k, best, names)
            nodes, bound, batch = nodes[n:], bound[n:], 2 * batch
            still = bound >= best[rows, k - 1].min()
            nodes, bound = nodes[still], bound[still]
    return done


def score_leaves(queries, rows, query_ids, data, data_ids, nodes, k, best, names) -> int:
    points = np.concatenate([data.order[data.low[n] : data.high[n]] for n in nodes])
    scores = products(queries.vectors[rows], data.vectors[points])
    ids = data_ids[points]
    for i, row in enumerate(rows.tolist()):
        fit = np.flatnonzero((scores[i] >= best[row, k - 1]) & (ids != query_ids[row]))
        if len(fit) > 4 * k:
            # Far more than k: those below the k-th best of them go first, its ties stay.
            fit = fit[scores[i][fit] >= np.partition(scores[i][fit], -k)[-k]]
        if len(fit):
            s, n = np.concatenate((best[row], scores[i][fit])), np.concatenate((names[row], ids[fit]))
            top = np.lexsort((n, -s))[:k]
            best[row], names[row] = s[top], n[top]
    return scores.size


NONE = -(1 << 62)


def top_k(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product for each row that ``queries`` holds for.

    Components x become floor(scale * x). Rows of the query's own key are not
    its results; ties go to the smaller key. Queries and data lie in blocks of
    about ``block`` rows, each with its cover tree. SIDE blocks of queries meet
    SIDE blocks of data in a group, which unpacks each tree once, searches them
    together and keeps each query's k best; the number of groups grows with the
    data, their size does not. Then the best of all groups are ranked, k a group
    being combined before that shuffle.

    Null keys, and vectors that are null, empty, or hold null or non-finite
    components, take no part; vectors meet those of their own length only, of
    any length. With fewer than k others, all are returned. Repeated rows are
    results of their own. Other columns are not read. An empty input gives no
    rows.
    """
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = vectors.where(good).select(F.col(key).alias("id"), whole.alias("v"), F.size(vector).alias("dim"), F.coalesce(queries, F.lit(False)).alias("asks"))
    counted = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    data_blocks, asking_blocks = (max(1, -(-n // block)) for n in counted)
    data_groups, asking_groups = -(-data_blocks // SIDE), -(-asking_blocks // SIDE)

    def trees(table: pa.Table) -> pa.Table:
        import pickle

        ids = table["id"].to_numpy().astype(np.int64)
        matrix = table["v"].combine_chunks().values.to_numpy().astype(np.int64).reshape(len(ids), -1)
        packed = pickle.dumps((ids, CoverTree(matrix)), protocol=5)
        return pa.table({"dim": table["dim"][:1], "block": table["block"][:1], "tree": pa.array([packed], pa.large_binary()).cast(pa.binary())})

    def planted(df: DataFrame, n: int, salt: int) -> DataFrame:
        """A tree for each block; a stated count of partitions, as little data makes much work here."""
        dealt = df.withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")).repartition(min(2 * n, MOST_PARTITIONS), "dim", "block")
        return cut(dealt.groupBy("dim", "block").applyInArrow(trees, "dim int, block int, tree binary"))

    data, asked = planted(rows, data_blocks, 1), planted(rows.where("asks"), asking_blocks, 2)
    cell = ("dim", "_data", "_asking")
    cells = min(2 * data_groups * asking_groups, MOST_PARTITIONS)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = F.floor(F.col("block") / SIDE).cast("int")
    left = asked.select("dim", group.alias("_asking"), numbers(data_groups).alias("_data"), "tree").repartition(cells, *cell)
    right = data.select("dim", group.alias("_data"), numbers(asking_groups).alias("_asking"), "tree").repartition(cells, *cell)

    def search(asking: pa.Table, there: pa.Table) -> pa.Table:
        import pickle

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        blocks = [pickle.loads(x) for x in there["tree"].to_pylist()]
        for packed in asking["tree"].to_pylist() if blocks else ():
            ids, tree = pickle.loads(packed)
            best, names = np.full((len(ids), k), NONE), np.zeros((len(ids), k), np.int64)
            for other, points in blocks:
                dual_search(tree, ids, points, other, k, best, names)
            real = best > NONE
            found.append((np.repeat(ids, real.sum(axis=1)), names[real], best[real]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
