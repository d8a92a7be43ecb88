"""Vectors in epsilon grid order: rotation onto principal dimensions, grid cells, sorted blocks.

The rotation is orthonormal, so distances and inner products stay what they are.  The order sorts
vectors by the grid cells (of a given width) of their leading principal dimensions, compared one after
the other; a block is a run of that order, and carries the box around its vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from brindle.llm.common import written

LEAD = 8
BLOCK_BYTES = 1 << 17
#: A block's number: the number of its partition, then its place in it.
PLACES = 1 << 24
#: Parquet looks at the size of what it holds after 100 rows only, which long rows make hundreds of MB; here after each.
LONG_ROWS = {"parquet.block.size": str(1 << 24), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Children of a node, of trees over blocks.
FAN = 16


def dimension(df: DataFrame, vector_col: str) -> int:
    """The most frequent length of a vector (the greater one of a tie); 0 if there is none."""
    n = df.groupBy(F.size(vector_col).alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return n["d"] if n else 0


def usable(df: DataFrame, id_col: str, vector_col: str, d: int) -> DataFrame:
    """(id, vector) of the rows with an id and ``d`` finite entries, not all of them zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") == d))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18))
    return rows.where(fine & F.exists("vector", lambda x: x != 0))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(d: int, normal: bool):
    def run(batches):
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            x = matrix(b.column(1), d)
            x = np.concatenate([unit(x) if normal else x, np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        i, j = np.triu_indices(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i * (d + 1) + j), pa.array(total[i, j])], ["cell", "value"])
    return run


def rotation(rows: DataFrame, d: int, normal: bool = True) -> tuple[np.ndarray, float]:
    """[d, d]: the principal axes of all rows, strongest first, and the deviation along the first.  Each partition adds up its products; only
    d * d / 2 sums come to the driver, whatever the input."""
    sums = rows.mapInArrow(_moments(d, normal), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    m = np.zeros((d + 1) ** 2)
    m[sums["cell"].to_numpy(np.int64)] = sums["value"].to_numpy()
    m = m.reshape(d + 1, d + 1)
    m = np.triu(m) + np.triu(m, 1).T
    n = max(m[d, d], 1.0)
    mean = m[:d, d] / n
    value, axes = np.linalg.eigh(m[:d, :d] / n - np.outer(mean, mean))
    return axes[:, np.argsort(-value, kind="stable")], float(np.sqrt(max(value.max(), 0)))


def _turned(shared, d: int, width: float, lead: int, normal: bool):
    def run(batches):
        axes = shared.value
        for b in batches:
            x = matrix(b.column(1), d)
            x = (unit(x) if normal else x) @ axes
            cells = np.clip(np.floor(x[:, :lead] / width), -(1 << 31), (1 << 31) - 1).astype(np.int64) + (1 << 31)
            keys = cells.astype(">u4")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in keys], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "cell", "vec"])
    return run


def _cut(d: int, rows: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        ids, vecs, held, k = [], [], 0, 0

        def block(n):
            nonlocal ids, vecs, held, k
            i, x = np.concatenate(ids), np.concatenate(vecs)
            ids, vecs = [i[n:]], [x[n:]]
            held = len(i) - len(i[:n])
            i, x = i[:n], x[:n]
            out = pa.RecordBatch.from_arrays(
                [pa.array([part * PLACES + k]), pa.array([i.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([x.min(0).tolist()]), pa.array([x.max(0).tolist()])], ["block", "ids", "vecs", "lo", "hi"])
            k += 1
            return out

        for b in batches:
            if b.num_rows:
                ids.append(b.column(0).to_numpy())
                vecs.append(np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, d))
                held += b.num_rows
            while held >= rows:
                yield block(rows)
        if held:
            yield block(held)
    return run


def blocks(df: DataFrame, id_col: str, vector_col: str, d: int, width: float | None, normal: bool = True, lead: int = LEAD, rows: int | None = None) -> DataFrame:
    """(block, ids, vecs, lo, hi), written: runs of epsilon grid order, as little-endian int64 ids and
    float64 rotated vectors, and the boxes around them.  One sort of the table; the cell and the id are
    the key, so a cell full of copies is cut like everything else.  Blocks are numbered from 0 in their order, by the
    numbers of blocks of the partitions before, of which the driver holds one each.  No ``width``: the deviation along
    the first principal dimension."""
    usables = usable(df, id_col, vector_col, d)
    axes, spread = rotation(usables, d, normal)
    shared = df.sparkSession.sparkContext.broadcast(axes)
    turned = usables.mapInArrow(_turned(shared, d, width or spread or 1.0, min(lead, d), normal), "id long, cell binary, vec binary")
    ordered = turned.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id", "vec").select("id", "vec")
    cut = ordered.mapInArrow(_cut(d, rows or max(16, BLOCK_BYTES // (8 * d))), "block long, ids binary, vecs binary, lo array<double>, hi array<double>")
    out = written(cut, "blocks", LONG_ROWS if rows else None)
    part = F.expr(f"block div {PLACES}")
    before, total = [], 0
    for r in sorted(out.groupBy(part.alias("p")).count().collect()):
        before.append((r["p"], total))
        total += r["count"]
    first = df.sparkSession.createDataFrame(before, "_p long, _first long")
    return out.join(F.broadcast(first), part == F.col("_p")).withColumn("block", F.col("_first") + F.col("block") % PLACES).drop("_p", "_first")


def descend(top: int, level, near):
    """The near pairs of nodes of a tree whose nodes are numbered in order, level by level from its root (level ``top``).

    ``level(k)`` gives the nodes of level k as a DataFrame with a column "node"; a node's parent is node div ``FAN``.
    ``near(a, b, pairs)`` joins the two sides of candidate pairs (a, b) and keeps those that may be near.  Only the children
    of near pairs are ever paired, by joins on their parents: no level pairs all its nodes."""
    spark = level(0).sparkSession
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    for k in range(top - 1, -1, -1):
        nodes = level(k).select("node", F.expr(f"node div {FAN}").alias("up"))
        left = nodes.select(F.col("up").alias("a"), F.col("node").alias("na"))
        right = nodes.select(F.col("up").alias("b"), F.col("node").alias("nb"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
        pairs = written(near(k, both), "node-pairs")
    return pairs


def height(nodes: int) -> int:
    """The level of the root of a tree over so many nodes."""
    k = 0
    while nodes > 1:
        nodes, k = -(-nodes // FAN), k + 1
    return k
