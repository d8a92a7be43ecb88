"""Dependency queries: duplicate versions, unused features, sizes, crate and module graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def crate_edges(deps: DataFrame, crates: DataFrame) -> DataFrame:
    """(src, dst, kind): dependencies on crates of the workspace."""
    own = crates.select(F.col("name").alias("dst")).distinct()
    return deps.select(F.col("crate").alias("src"), F.col("name").alias("dst"), "kind").join(own, "dst", "left_semi").select("src", "dst", "kind").distinct()


def duplicate_versions(packages: DataFrame, callers: DataFrame) -> DataFrame:
    """(name, version, callers) of names with two versions or more, from packages (name, version) and
    callers (name, version or null, caller): a null version means all versions."""
    versions = packages.groupBy("name").agg(F.collect_list("version").alias("versions")).where(F.size("versions") >= 2)
    each = versions.select("name", F.explode(F.array_distinct("versions")).alias("version"))
    c = callers.select("name", F.col("version").alias("_v"), "caller")
    hit = each.join(c, (each["name"] == c["name"]) & (F.col("_v").isNull() | (F.col("_v") == F.col("version"))), "left").select(each["name"], "version", "caller")
    return hit.groupBy("name", "version").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def lock_callers(packages: DataFrame) -> DataFrame:
    """(name, version, caller) from lock packages: dependency strings are a name and maybe a version."""
    d = packages.select(F.concat_ws("@", "name", "version").alias("caller"), F.explode("dependencies").alias("d"))
    parts = F.split("d", r"\s+")
    return d.select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("version"), "caller")


def unused_terms(texts: DataFrame, terms: DataFrame, group: str = "crate", text: str = "text") -> DataFrame:
    """(group, term) of terms that no text of the group has.  One pass over the texts: per text an array of
    the terms found, then their union; no text is shuffled.  ``terms`` (ord, term) is a small list."""
    words = [r["term"] for r in terms.orderBy("ord").collect()]
    found = texts.select(group, F.filter(F.array(*(F.when(F.contains(F.col(text), F.lit(w)), F.lit(i)) for i, w in enumerate(words))), lambda x: x.isNotNull()).alias("_f"))
    hit = found.select(group, F.explode("_f").alias("_i")).distinct()
    every = texts.select(group).distinct().crossJoin(F.broadcast(terms.sparkSession.createDataFrame([(i, w) for i, w in enumerate(words)], "_i int, term string")))
    return every.join(hit, [group, "_i"], "left_anti").select(group, "term")


def shares(sizes: DataFrame, name: str = "name", size: str = "size") -> DataFrame:
    """(name, size, percent) of the total; 0 if the total is 0."""
    total = sizes.agg(F.sum(size).alias("_total"))
    return sizes.crossJoin(F.broadcast(total)).select(name, size, F.when(F.col("_total") > 0, F.col(size) * 100.0 / F.col("_total")).otherwise(F.lit(0.0)).alias("percent"))


def reverse_crate_deps(refs: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    """(from_crate) that refer to ``target``: by root, or without a root to a name it has."""
    own = symbols.where(F.col("crate_name") == target).select(F.col("name").alias("_n")).distinct()
    outside = refs.where(F.col("from_crate") != target)
    by_root = outside.where(F.col("root") == target).select("from_crate")
    by_name = outside.where("root is null").join(own, F.col("name") == F.col("_n"), "left_semi").select("from_crate")
    return by_root.union(by_name).distinct()


def module_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(crate, src, dst): module references within crates, from refs (crate, from_module, name, root,
    prefix, is_path_segment) and symbols (crate, module, name): a known module that defines the name,
    else the only module that does, if there is a root; never from or to the crate's own root."""
    s = symbols.select("crate", F.col("module").alias("_m"), F.col("name").alias("_n")).distinct()
    many = Window.partitionBy("crate", "_n")
    s = s.withColumn("_modules", F.count("*").over(many))
    local = refs.where(F.col("root").isNull() | F.col("root").isin("crate", "self", "super", "Self"))
    hit = local.join(s, (local["crate"] == s["crate"]) & (F.col("name") == F.col("_n"))).drop(s["crate"])
    exact = F.col("prefix") == F.col("_m")
    ok = exact | ((F.col("_modules") == 1) & F.col("root").isNotNull())
    return hit.where(ok & (F.col("from_module") != F.col("_m")) & (F.col("from_module") != "crate") & (F.col("_m") != "crate")).select("crate", F.col("from_module").alias("src"), F.col("_m").alias("dst")).distinct()
