"""Reports over findings: counts, top lists, snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SEVERITIES = ("error", "warning", "info")


def by_detector(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def by_kind(findings: DataFrame, key: str) -> DataFrame:
    """(kind, severity, n, first_id): findings of a kind and severity, and the first of them."""
    return findings.groupBy("kind", "severity").agg(F.count("*").alias("n"), F.min(key).alias("first_id"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Every severity in its order, zero where nothing has it."""
    domain = findings.sparkSession.createDataFrame([(i, s) for i, s in enumerate(SEVERITIES)], "ord int, severity string")
    n = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(n, "severity", "left").select("ord", "severity", F.coalesce("n", F.lit(0)).alias("n")).orderBy("ord")


def top_files(findings: DataFrame, limit: int = 10) -> DataFrame:
    return findings.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(limit)


def top_complexity(measures: DataFrame, key: str = "qualified", limit: int = 10) -> DataFrame:
    return measures.orderBy(F.desc("cyclo"), F.desc("cog"), key).limit(limit)


def fixable(findings: DataFrame, kinds: tuple[str, ...] = ("dead-code", "unused-dep")) -> DataFrame:
    """(total, edits, percent): whole percent, rounded down; 0 of nothing."""
    n = findings.agg(F.count("*").alias("total"), F.count_if(F.col("kind").isin(*kinds)).alias("edits"))
    return n.withColumn("percent", F.when(F.col("total") > 0, F.expr("edits * 100 div total")).otherwise(0))


def identity(findings: DataFrame) -> DataFrame:
    """``findings`` with ``identity``: what stays the same when lines move.  Cycle nodes and clone members
    are sorted, so their order doesn't count; clusters go by their members."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = (
        F.when(F.col("kind") == "dead-code", s("symbol")).when(F.col("kind") == "unused-dep", F.concat_ws("/", s("crate_name"), s("dep_name"), s("dep_kind")))
        .when(F.col("kind") == "circular-dep", F.array_join(F.array_sort("cycle"), ",")).when(F.col("kind") == "duplicate", F.array_join(F.array_sort(F.array(s("symbol_a"), s("symbol_b"))), ","))
        .when(F.col("kind") == "duplicate-cluster", F.array_join(F.array_sort(F.transform("members", lambda m: m["symbol"])), ",")).when(F.col("kind") == "complexity", s("symbol"))
        .when(F.col("kind") == "boundary", F.concat_ws("/", s("from_crate"), s("to_path"), s("rule"))).otherwise(F.concat_ws("/", s("source"), s("category"), s("message"))))
    return findings.withColumn("identity", F.concat(s("file"), F.lit("|"), F.col("kind"), F.lit(":"), key))


def snapshot_diff(base: DataFrame, head: DataFrame, key: str = "identity") -> DataFrame:
    """Rows with ``state``: resolved (only in base), introduced (only in head) or unchanged (head's rows
    whose key base has too).  Rows keep their multiplicity."""
    b, h = base.select(F.col(key).alias("_k")).distinct(), head.select(F.col(key).alias("_k")).distinct()
    resolved = base.join(h, F.col(key) == F.col("_k"), "left_anti").withColumn("state", F.lit("resolved"))
    known = head.join(b.withColumn("_old", F.lit(True)), F.col(key) == F.col("_k"), "left")
    rest = known.withColumn("state", F.when(F.col("_old"), "unchanged").otherwise("introduced")).drop("_k", "_old")
    return resolved.unionByName(rest)


def counters(diff: DataFrame) -> DataFrame:
    """(kind, resolved, introduced, unchanged, net) of a snapshot difference, and a row "total" last."""
    n = [F.count_if(F.col("state") == x).alias(x) for x in ("resolved", "introduced", "unchanged")]
    each = diff.select("kind", "state").rollup("kind").agg(*n, F.grouping_id().alias("_all"))
    return each.withColumn("net", F.col("introduced") - F.col("resolved")).orderBy("_all", "kind").select(F.when(F.col("_all") == 1, "total").otherwise(F.col("kind")).alias("kind"), "resolved", "introduced", "unchanged", "net")


def top_clusters(findings: DataFrame, limit: int = 10) -> DataFrame:
    """Clone clusters with the most members."""
    own = findings.where("kind = 'duplicate-cluster'").withColumn("n", F.size("members"))
    return own.orderBy(F.desc("n"), F.desc("similarity"), "file", "line").limit(limit).select("file", "line", "n", "similarity", F.transform("members", lambda m: m["symbol"]).alias("symbols"))
