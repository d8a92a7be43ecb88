"""Near-duplicate embeddings: an epsilon grid order join (Boehm et al., SIGMOD 2001).

Vectors of length 1 whose cosine is at least c lie within eps = sqrt(2 - 2c).  ``vectors.blocks`` sorts
them by grid cells of width eps on their leading principal dimensions.  Sequence intervals are then
joined recursively: the whole sequence with itself, then the parts of intervals that may be near, down to intervals of
``SPAN`` blocks; the blocks of those; and within a task halves of block runs, down to single blocks.  At each
level a pair is skipped if the gap between the two boxes is more than eps, which proves that no pair of vectors
is near; what is skipped is never paired again.

A task gives the edges of a spanning forest of the near pairs it finds, so that a group of n copies
costs n rows and not n * n; the groups are the connected components of all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.llm.common import written
from brindle.llm.components import connected_components
from brindle.llm.vectors import FAN, blocks, descend, dimension, height

COSINE = 0.95
SPAN = 32
_BOX = 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the edges a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


class _Run:
    """A run of blocks: vectors, ids, where its blocks begin, and their boxes."""

    def __init__(self, blocks_, d):
        self.ids = np.concatenate([np.frombuffer(i, np.int64) for i, _ in blocks_])
        self.x = np.concatenate([np.frombuffer(v, np.float64).reshape(-1, d) for _, v in blocks_])
        self.at = np.concatenate([[0], np.cumsum([len(i) // 8 for i, _ in blocks_])])
        self.lo = np.stack([self.x[p:q].min(0) for p, q in zip(self.at, self.at[1:])])
        self.hi = np.stack([self.x[p:q].max(0) for p, q in zip(self.at, self.at[1:])])


def _distant(a: _Run, i: int, j: int, b: _Run, k: int, m: int, eps: float) -> bool:
    gap = np.maximum(b.lo[k:m].min(0) - a.hi[i:j].max(0), a.lo[i:j].min(0) - b.hi[k:m].max(0))
    return float((np.maximum(gap, 0) ** 2).sum()) > eps * eps * (1 + 1e-9)


def join_runs(a: _Run, b: _Run, same: bool, eps: float, found: list) -> None:
    """Appends (ids, ids) of the near pairs of two runs (of a run with itself, each pair once)."""
    least = 1 - eps * eps / 2
    todo = [(0, len(a.at) - 1, 0, len(b.at) - 1)]
    held = 0
    while todo:
        i, j, k, m = todo.pop()
        if _distant(a, i, j, b, k, m, eps):
            continue
        if j - i <= 1 and m - k <= 1:
            p, q, r, s = a.at[i], a.at[j], b.at[k], b.at[m]
            u, v = np.nonzero(a.x[p:q] @ b.x[r:s].T >= least)
            if same and i == k:
                u, v = u[u < v], v[u < v]
            if len(u):
                u, v = a.ids[p + u], b.ids[r + v]
                if len(u) > 4 * (q - p + s - r):
                    u, v = forest(u, v)
                found.append((u, v))
                held += len(u)
                if held > 1 << 20:
                    found[:] = [forest(*map(np.concatenate, zip(*found)))]
                    held = len(found[0][0])
            continue
        left = [(i, (i + j) // 2), ((i + j) // 2, j)] if j - i > 1 else [(i, j)]
        right = [(k, (k + m) // 2), ((k + m) // 2, m)] if m - k > 1 else [(k, m)]
        todo += [(*x, *y) for x in left for y in right if not same or y[1] > x[0]]


def _join(d: int, eps: float):
    def run(key, table):
        s, t = (k.as_py() for k in key)
        rows = sorted(zip(table["block"].to_pylist(), table["ids"].to_pylist(), table["vecs"].to_pylist(), table["super"].to_pylist()))
        a = _Run([(i, v) for _, i, v, x in rows if x == s], d)
        found: list = []
        if s == t:
            join_runs(a, a, True, eps, found)
        else:
            join_runs(a, _Run([(i, v) for _, i, v, x in rows if x == t], d), False, eps, found)
        u, v = forest(*map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})
    return run


def _gap(n: int):
    """Square of the distance of two boxes (lo, hi) and (lo2, hi2) over ``n`` dimensions."""
    each = [F.pow(F.greatest(F.lit(0.0), F.col("lo2")[k] - F.col("hi")[k], F.col("lo")[k] - F.col("hi2")[k]), F.lit(2.0)) for k in range(n)]
    return sum(each[1:], each[0])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, keep_id): every vector that has a near copy with a lesser id in its group, and the least id
    of the group.  Groups are the connected components of all pairs with a cosine of at least ``cosine``
    (to about 1e-12), by exact search.

    Rows with a null id, a null or zero vector, an entry that is null or not finite, or another length
    than the table's most frequent one belong to no group.  Rows that repeat an id count as one, near to
    whatever any of them is near to.  An empty table gives no rows; other columns are ignored.

    What is shuffled beside the one sort: each block once for every interval pair it may have a
    partner in.
    """
    spark = vectors.sparkSession
    d = dimension(vectors, vector_col)
    if not d:
        return spark.createDataFrame([], "vec_id long, keep_id long")
    eps = float(np.sqrt(max(2 - 2 * cosine, 0))) or 1e-6
    cut = blocks(vectors, id_col, vector_col, d, eps)
    n = min(_BOX, d)
    meta = cut.select("block", F.expr(f"block - block % {SPAN}").alias("super"), F.slice("lo", 1, n).alias("lo"), F.slice("hi", 1, n).alias("hi"))
    ends = lambda f, c: F.array(*(f(F.col(c)[k]) for k in range(n))).alias(c)
    levels = [written(meta.groupBy(F.expr(f"block div {SPAN}").alias("node")).agg(ends(F.min, "lo"), ends(F.max, "hi")), "boxes")]
    for _ in range(height(levels[0].count())):
        levels.append(written(levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(ends(F.min, "lo"), ends(F.max, "hi")), "boxes"))
    other = lambda df, *names: df.select(*(F.col(c).alias(f"{c}2") for c in ("lo", "hi", *names)))
    most = eps * eps * (1 + 1e-9)

    def near_pairs(k, pairs):
        own = pairs.where("a <= b").join(levels[k].withColumnRenamed("node", "a"), "a").join(other(levels[k], "node").withColumnRenamed("node2", "b"), "b")
        return own.where(_gap(n) <= most).select("a", "b")

    near = descend(len(levels) - 1, levels.__getitem__, near_pairs).select((F.col("a") * SPAN).alias("s"), (F.col("b") * SPAN).alias("t"))
    both = near.join(meta.withColumnRenamed("super", "s"), "s").join(other(meta, "super", "block").withColumnRenamed("super2", "t"), "t").where((F.col("block") <= F.col("block2")) & (_gap(n) <= most))
    needed = both.select("s", "t", F.explode(F.array("block", "block2")).alias("block")).distinct()
    loaded = needed.join(cut.select("block", "ids", "vecs", F.expr(f"block - block % {SPAN}").alias("super")), "block")
    edges = written(loaded.groupBy("s", "t").applyInArrow(_join(d, eps), "a long, b long"), "near-vectors")
    return connected_components(edges).where("node <> comp").select(F.col("node").alias("vec_id"), F.col("comp").alias("keep_id"))


def ego_sql(cosine: float) -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) >= {cosine} * a.n * b.n),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT a AS vec_id, min(b) AS keep_id FROM reach GROUP BY a HAVING min(b) < a
"""
