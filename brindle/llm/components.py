"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brindle.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node with an edge; comp is the component's least node.

    Each step is one shuffle by node; every round is written to the shared folder, and the rounds end
    when no edge changes.  Self loops, nulls and repeated edges don't matter; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, "cc")
    seen = None
    while True:
        # large star: link each node's larger neighbours to its least neighbour or itself
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", m).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: link a node's smaller neighbours, and itself, to the least of them
        w = F.min("v").over(Window.partitionBy("u"))
        s = large.withColumn("m", w)
        both = s.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = written(both.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())
        seen = now
