"""Exact top-k inner-product search with a dual cover tree.

Queries and data are cut into blocks of bounded size. Each pair of a query block
and a data block is one task's work: it builds a cover tree over either side and
walks both together. For nodes with centres q, x and covering radii a, b every
inner product between their members is at most q.x + |q| b + |x| a + a b; a node
pair whose bound is below the worst kth score of the query group is pruned. Inside a
leaf of the query tree every query is then a group of its own (b = 0 on its side): those
whose own kth score is above their bound leave the walk below that data node. The
blocks' winners are merged by rank.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DATA_BLOCK = 4096
QUERY_BLOCK = 1024
LEAF = 16


def quantized(embedding: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null where the vector is
    null, empty or holds a null or non-finite component."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(e) > 0) & ~bad, F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class Node:
    """Centre, covering radius over all descendants, child nodes, and the children
    that are single points (or the points of a leaf)."""

    __slots__ = ("centre", "norm", "radius", "children", "points", "members")

    def __init__(self, centre, radius, children, points, members):
        self.centre, self.radius, self.children, self.points, self.members = centre, radius, children, points, members
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(x: np.ndarray) -> Node:
    """A cover tree: the children of a node are a net whose centres are more than ``step`` apart and
    cover their members within ``step``, the greatest power of two below the node's radius."""

    def make(members: np.ndarray, centre_at: int) -> Node:
        centre = x[centre_at]
        d = np.sqrt(np.maximum(((x[members] - centre) ** 2).sum(axis=1), 0))
        radius = float(d.max())
        if len(members) <= LEAF or radius == 0:
            return Node(centre, radius, [], members, members)
        step = 2.0 ** np.floor(np.log2(radius))
        step = step / 2 if step >= radius else step
        children, single, left, at = [], [], members, centre_at
        while len(left):
            near = ((x[left] - x[at]) ** 2).sum(axis=1) <= step * step
            near |= left == at
            own, left = left[near], left[~near]
            if len(own) == 1:
                single.append(own[0])
            else:
                children.append(make(own, at))
            if len(left):
                at = left[0]
        return Node(centre, radius, children, np.array(single, np.int64), members)

    return make(np.arange(len(x)), 0)


class Best:
    """The k best (score, smaller id) of every query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.at = k, np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        self.scored = 0                                  # query-row pairs whose product was computed

    def worst(self, queries: np.ndarray) -> float:
        return float(self.score[queries, -1].min())

    def offer(self, queries, score, at, ids) -> None:
        """``score[i, j]`` of ``queries[i]`` with data row ``at[j]``."""
        k = self.k
        score = np.concatenate([self.score[queries], score], axis=1)
        at = np.concatenate([self.at[queries], np.broadcast_to(at, (len(queries), len(at)))], axis=1)
        bar = np.partition(score, -k, axis=1)[:, -k]
        row, col = np.nonzero(score >= bar[:, None])
        s, a = score[row, col], at[row, col]
        order = np.lexsort((np.where(a >= 0, ids[a], np.iinfo(np.int64).max), -s, row))
        row, s, a = row[order], s[order], a[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        self.score[queries[row[keep]], rank[keep]] = s[keep]
        self.at[queries[row[keep]], rank[keep]] = a[keep]


def dual_search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """The k best rows of ``x`` by inner product for every row of ``q``; ties to the
    smaller id. Integer-valued input; sums beyond 2**53 are computed as integers."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2.0 ** 53
    best, qf, xf = Best(len(q), k), q.astype(np.float64), x.astype(np.float64)

    length = np.sqrt((qf * qf).sum(axis=1))

    def scores(a, b):
        return qf[a] @ xf[b].T if exact else (q[a] @ x[b].T).astype(np.float64)

    def slack(top):
        return top + np.abs(top) * 1e-9 + 1e-6

    def bound(a: Node, b: Node) -> float:
        return slack(float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius)

    def open_queries(members: np.ndarray, b: Node) -> np.ndarray:
        """The queries for which a row below ``b`` may still be among the k best."""
        return members[slack(qf[members] @ b.centre + length[members] * b.radius) >= best.score[members, -1]]

    def score_points(members: np.ndarray, points: np.ndarray) -> None:
        s = scores(members, points)
        best.scored += s.size
        better = (s >= best.score[members, -1][:, None]).any(axis=1)
        if better.any():
            best.offer(members[better], s[better], points, ids)

    def scan(members: np.ndarray, b: Node) -> None:
        """The rows below ``b`` for the queries of one leaf, likely ones first."""
        members = open_queries(members, b)
        if not len(members):
            return
        if len(b.points):
            score_points(members, b.points)
        middle = qf[members].mean(axis=0)
        reach = float(length[members].max())
        for child in sorted(b.children, key=lambda c: -(float(middle @ c.centre) + reach * c.radius)):
            scan(members, child)

    def walk(a: Node, b: Node) -> None:
        if bound(a, b) < best.worst(a.members):
            return
        for child in a.children:                         # split the query group first
            walk(child, b)
        if len(a.points):                                # the whole group, if it is a leaf
            scan(a.points, b)

    walk(cover_tree(qf), cover_tree(xf))
    return best


def top_k(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of ``data(vec_id, v)`` with the
    highest inner product for every row of ``queries(vec_id, v)``, a row with the
    query's own vec_id excepted; ties to the smaller vec_id; fewer rows if there
    are fewer.

    Null vectors and null ids take no part; vectors meet those of their own length.
    Repeated rows count once; equal vectors are searched once, whoever many share
    them, with the k + 1 smallest ids. Scores are longs (they wrap beyond).
    """
    data = data.filter("v is not null and vec_id is not null").select("vec_id", "v")
    queries = queries.filter("v is not null and vec_id is not null").select("vec_id", "v").distinct()
    first = Window.partitionBy("v").orderBy("vec_id")
    few = data.distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    vectors = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = materialize(queries.withColumn("qkey", F.xxhash64("v")), "queries")
    sought = asked.select("v").distinct()
    nd = max(1, -(-vectors.count() // DATA_BLOCK))
    nq = max(1, -(-sought.count() // QUERY_BLOCK))

    def spread(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(n):
        return F.pmod(F.xxhash64(F.lit(7), "v"), F.lit(n)).cast("int")

    none = F.array().cast("array<bigint>")
    rows = (vectors.select(block(nd).alias("d"), spread(nq).alias("q"), F.size("v").alias("dim"), "v", "ids")
            .unionByName(sought.select(block(nq).alias("q"), spread(nd).alias("d"), F.size("v").alias("dim"), "v",
                                       none.alias("ids"))))

    def search(t: pa.Table) -> pa.Table:
        n = pa.compute.list_value_length(t.column("ids")).to_numpy()
        dim = t.column("dim")[0].as_py()
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        q, x = v[n == 0], v[n > 0]
        ids = t.column("ids").combine_chunks().filter(pa.array(n > 0)).to_pylist()
        found = ([], [], [])
        if len(q) and len(x):
            best = dual_search(q, x, np.array([i[0] for i in ids], np.int64), k + 1)
            i, r = np.nonzero(best.at >= 0)
            at = best.at[i, r]
            found = (q[i].tolist(), (q[i] * x[at]).sum(axis=1).tolist(), [ids[a] for a in at])
        return pa.table({"v": pa.array(found[0], pa.list_(pa.int64())), "score": pa.array(found[1], pa.int64()),
                         "ids": pa.array(found[2], pa.list_(pa.int64()))})

    part = rows.groupBy("q", "d", "dim").applyInArrow(search, "v array<long>, score long, ids array<long>")
    best = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    merged = (part.select("v", "score", F.explode("ids").alias("vec_id"))
              .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1))
    own = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return (asked.withColumnRenamed("vec_id", "query_id").join(merged, "v")
            .filter("query_id <> vec_id").withColumn("rank", F.row_number().over(own))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
