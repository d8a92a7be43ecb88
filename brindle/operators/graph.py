"""Graphs: breadth-first search, strongly connected components, connected components.

Loops write each step below the folder of ``spark.checkpoint.dir``, so a lost executor costs no step.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names one; a temporary folder only where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, distance) of what the edges (src, dst) reach from ``starts`` (node), without the starts.

    A round joins the frontier with the edges and takes away what is known: frontier and known nodes are
    shuffled by node, edges by src.  Ends with an empty frontier or at ``max_depth``.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    frontier = written(starts.select("node").distinct(), "frontier")
    seen = frontier.select("node", F.lit(0).alias("distance"))
    depth = 0
    while (max_depth is None or depth < max_depth) and frontier.take(1):
        depth += 1
        reached = edges.join(frontier, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier.select("node", F.lit(depth).alias("distance")))
    return seen.where("distance > 0")


def cycles(edges: DataFrame, group: str | None = None) -> DataFrame:
    """(comp, node) of the strongly connected components of two nodes or more; comp is the least node.

    Forward-backward trimming with colours: nodes without an edge in or out drop out; every node takes
    the least colour that reaches it; those that reach their colour's node back within the colour are its
    component.  Edges (src, dst), and ``group`` if components stay within groups.
    """
    keys = [group] if group else []
    e = written(edges.select(*keys, "src", "dst").where("src <> dst").distinct(), "scc")
    found = None
    while True:
        while True:  # trim
            n = e.count()
            src, dst = e.select(*keys, F.col("src").alias("_x")).distinct(), e.select(*keys, F.col("dst").alias("_x")).distinct()
            same = lambda c, df: [e[k] == df[k] for k in keys] + [e[c] == df["_x"]]
            e = written(e.join(dst, same("src", dst), "left_semi").join(src, same("dst", src), "left_semi"), "scc")
            m = e.count()
            if m in (0, n):
                break
        if not m:
            break
        color = written(e.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("color", F.col("node")), "color")
        color = _spread(e, color, keys)
        back = _back(e, color, keys)
        found = back if found is None else found.unionByName(back)
        gone = back.select(*keys, F.col("node").alias("_x"))
        same = lambda c: [e[k] == gone[k] for k in keys] + [e[c] == gone["_x"]]
        e = written(e.join(gone, same("src"), "left_anti").join(gone, same("dst"), "left_anti"), "scc")
    if found is None:
        return edges.sparkSession.createDataFrame([], edges.select(*keys, F.col("src").alias("comp"), F.col("src").alias("node")).schema)
    w = Window.partitionBy(*keys, "comp")
    return found.withColumn("_n", F.count("*").over(w)).where("_n > 1").drop("_n")


def _spread(e: DataFrame, color: DataFrame, keys: list[str]) -> DataFrame:
    """The least colour that reaches each node."""
    while True:
        src = color.select(*keys, F.col("node").alias("src"), F.col("color").alias("new"))
        got = e.join(src, [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.min("new").alias("new"))
        both = color.join(got, [*keys, "node"], "left").select(*keys, "node", "color", F.least("color", "new").alias("least"))
        both = written(both, "color")
        done = not both.where("least < color").take(1)
        color = both.select(*keys, "node", F.col("least").alias("color"))
        if done:
            return color


def _back(e: DataFrame, color: DataFrame, keys: list[str]) -> DataFrame:
    """(comp, node): of each colour's nodes those that reach the colour's own node without leaving it."""
    a = color.select(*keys, F.col("node").alias("src"), F.col("color").alias("ca"))
    b = color.select(*keys, F.col("node").alias("dst"), F.col("color").alias("cb"))
    own = written(e.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).where("ca = cb").select(*keys, "src", "dst", F.col("ca").alias("comp")), "scc")
    frontier = written(color.where("node = color").select(*keys, "node", F.col("color").alias("comp")), "frontier")
    seen = frontier
    while frontier.take(1):
        hop = own.join(frontier.withColumnRenamed("node", "dst"), [*keys, "dst", "comp"]).select(*keys, F.col("src").alias("node"), "comp").distinct()
        frontier = written(hop.join(seen, [*keys, "node", "comp"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen.select(*keys, "comp", "node")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the undirected edges (a, b); comp is the least node.  Alternating large-star and
    small-star steps (Kiveris et al., SoCC 2014), a shuffle by node each."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    seen = None
    w = Window.partitionBy("u")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(w), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        pairs = large.withColumn("m", F.min("v").over(w)).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = written(pairs.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        seen = now


def functional_edges(weights: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """(src, dst): for each source its heaviest target, ties to the least."""
    best = weights.groupBy(F.col(src).alias("src")).agg(F.min(F.struct((-F.col(weight)).alias("w"), F.col(dst).alias("dst"))).alias("b"))
    return best.select("src", F.col("b.dst").alias("dst"))
