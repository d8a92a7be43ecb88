"""Incremental parse cache: which files are parsed again, and replay of those that aren't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

SCHEMA_VERSION = 1


def plan(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, state) from files (path, mtime) and the cache's (path, mtime): hit if the file isn't newer,
    miss if it is or isn't cached, evict if a cached path is gone."""
    c = cached.groupBy("path").agg(F.max("mtime").alias("_cached"))
    f = files.select("path", F.col("mtime").alias("_mtime"))
    state = F.when(F.col("_mtime").isNull(), "evict").when(F.col("_mtime") <= F.col("_cached"), "hit").otherwise("miss")
    return f.join(c, "path", "full").withColumn("state", state)


def refresh(files: DataFrame, cached: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): cached rows of hits and parsed rows of misses.  ``cached`` has path, mtime and whatever
    ``parse`` gives for files (path, mtime, ...)."""
    p = plan(files, cached.select("path", "mtime"))
    hits = cached.join(p.where("state = 'hit'").select("path"), "path", "left_semi")
    fresh = parse(files.join(p.where("state = 'miss'").select("path"), "path", "left_semi"))
    return hits.unionByName(fresh), p


def counters(p: DataFrame) -> DataFrame:
    return p.agg(F.count_if(F.col("state") == "hit").alias("hits"), F.count_if(F.col("state") == "miss").alias("misses"), F.count_if(F.col("state") == "evict").alias("evicted"))


def load(spark, path: str, version: int = SCHEMA_VERSION) -> DataFrame | None:
    """The cache below ``path`` of this version; None if there is none or it can't be read."""
    try:
        df = spark.read.parquet(f"{path}/v{version}")
        df.schema  # noqa: B018
        return df
    except Exception:  # noqa: BLE001  a broken cache counts as none
        return None


def save(rows: DataFrame, path: str, version: int = SCHEMA_VERSION) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/v{version}")
