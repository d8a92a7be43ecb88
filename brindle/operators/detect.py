"""Detectors: dead items, unused dependencies, boundary violations, visibility, complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.operators.resolve import unreferenced

EXEMPT = ("is_test", "is_entry_point", "has_no_mangle", "has_export_name", "impl_of_foreign_trait")


def eligible(symbols: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """Symbols that may be dead: visible outside their module, without an exempting flag or name."""
    flags = [c for c in EXEMPT if c in symbols.columns]
    own = symbols.where(F.col("visibility").isin("public", "pub_crate"))
    for c in flags:
        own = own.where(~F.col(c))
    return own.where(~F.col("name").isin(*allow)) if allow else own


def dead_items(symbols: DataFrame, refs: DataFrame, allow: list[str] | None = None) -> DataFrame:
    return unreferenced(eligible(symbols, allow), refs)


def used_names(refs: DataFrame) -> DataFrame:
    """(_crate, _used): the names and roots each crate refers to."""
    return refs.select(F.col("from_crate").alias("_crate"), F.explode(F.array("name", "root")).alias("_used")).where("_used is not null").distinct()


def unused_deps(deps: DataFrame, refs: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """Dependencies (crate_key, name, rename, kind, optional) that no reference of their crate names,
    neither as they are nor in their local form."""
    own = deps.where("kind <> 'build' and not optional")
    local = F.coalesce("rename", F.replace("name", F.lit("-"), F.lit("_")))
    own = own.withColumn("_local", local)
    if allow:
        own = own.where(~F.col("name").isin(*allow) & ~F.col("_local").isin(*allow))
    used = used_names(refs)
    by = lambda c: (F.col("crate_key") == F.col("_crate")) & (F.col(c) == F.col("_used"))
    return own.join(used, by("_local"), "left_anti").join(used, by("name"), "left_anti").drop("_local")


def boundary_violations(refs: DataFrame, rules: DataFrame, path: str = "path", scope: Column | None = None) -> DataFrame:
    """Rows of ``refs`` that break a rule (rule_ord, from, allow, deny): the path begins like a denied
    prefix, or some are allowed and it begins like none of them.  One row per reference and rule.

    ``scope`` says where a rule holds (default: ``from_crate`` equals ``from``, or ``from_path`` begins
    with it).  Rules are configuration and the smaller side of the nested-loop join.
    """
    if scope is None:
        scope = (F.col("from_crate") == F.col("from")) | F.col("from_path").startswith(F.col("from"))
    begins = lambda prefix: F.col(path).startswith(prefix)
    denied = F.filter("deny", begins)
    both = refs.join(F.broadcast(rules), scope)
    rule = F.when(F.size(denied) > 0, F.concat(F.lit("deny "), F.get(denied, F.lit(0)))).when((F.size("allow") > 0) & ~F.exists("allow", begins), F.lit("not in allow list"))
    return both.withColumn("rule", rule).where("rule is not null")


def first_prefix(rows: DataFrame, owners: DataFrame, path: str, prefix: str, order: str, row_key: list[str], longest: bool = False) -> DataFrame:
    """Each row with the owner whose ``prefix`` its path begins with (as whole components): the first by
    ``order``, or the longest.  Owners are a small table; rows without one are left out."""
    inside = (F.col(path) == F.col(prefix)) | F.col(path).startswith(F.concat(F.col(prefix), F.lit("/")))
    both = rows.join(F.broadcast(owners), inside)
    rank = [F.desc(F.length(prefix)), F.desc(order)] if longest else [F.asc(order)]
    w = Window.partitionBy(*row_key).orderBy(*rank)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scoped(findings: DataFrame, impacted: DataFrame, key: str) -> DataFrame:
    """Findings of impacted crates; all findings if none is impacted."""
    none = impacted.agg((F.count("*") == 0).alias("_none"))
    hit = findings.join(impacted.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left").crossJoin(F.broadcast(none))
    return hit.where(F.col("_none") | F.col("_k").isNotNull()).drop("_k", "_none")


def visibility_suggestions(uses: DataFrame) -> DataFrame:
    """From (symbol_id, visibility, same_file, same_crate), a row per reference: what a symbol's visibility
    could be.  Symbols without a reference or with one from another crate have no suggestion."""
    per = uses.groupBy("symbol_id", "visibility").agg(F.count("*").alias("n_refs"), F.bool_and("same_file").alias("file_only"), F.bool_and("same_crate").alias("crate_only"))
    want = F.when(F.col("file_only"), "private").when(F.col("crate_only"), "pub_crate")
    return per.withColumn("suggested", want).where("suggested is not null and suggested <> visibility").select("symbol_id", "visibility", "suggested", "n_refs")


def hotspots(measures: DataFrame, cyclomatic: int = 15, cognitive: int = 25) -> DataFrame:
    """Functions over a threshold (strictly)."""
    return measures.where((F.col("cyclo") > cyclomatic) | (F.col("cog") > cognitive))
