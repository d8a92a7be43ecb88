"""Findings and graphs as text: lines for people, JSON, Markdown, DOT."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F


def human(prefix: str = "") -> Column:
    """One line per finding."""
    at = F.when(F.col("line") > 0, F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"))).otherwise(F.coalesce("file", F.lit("")))
    say = (
        F.when(F.col("kind") == "dead-code", F.format_string("unused %s `%s`", F.coalesce("symbol_kind", F.lit("item")), "symbol"))
        .when(F.col("kind") == "unused-dep", F.format_string("unused %s dependency `%s` of `%s`", "dep_kind", "dep_name", "crate_name"))
        .when(F.col("kind") == "circular-dep", F.concat(F.lit("cycle: "), F.array_join("cycle", " -> ")))
        .when(F.col("kind") == "duplicate", F.format_string("`%s` and `%s` are %.2f alike", "symbol_a", "symbol_b", "similarity"))
        .when(F.col("kind") == "duplicate-cluster", F.concat(F.size("members").cast("string"), F.lit(" alike: "), F.array_join(F.transform("members", lambda m: m["symbol"]), ", ")))
        .when(F.col("kind") == "complexity", F.format_string("`%s` has complexity %d (cognitive %d)", "symbol", "cyclo", "cog"))
        .when(F.col("kind") == "boundary", F.format_string("`%s` must not use `%s` (%s)", "from_crate", "to_path", "rule")).otherwise(F.coalesce("message", F.lit(""))))
    return F.concat(F.lit(prefix), F.col("severity"), F.lit(": "), say, F.lit(" ("), at, F.lit(")"))


def nested() -> Column:
    """A finding as JSON, with what belongs to its kind in an object of its own."""
    own = [c for c in ("symbol", "symbol_kind", "crate_name", "dep_name", "dep_kind", "cycle", "members", "symbol_a", "symbol_b", "similarity", "from_crate", "to_path", "rule", "cyclo", "cog", "source", "category", "message")]
    return F.to_json(F.struct(F.lit(1).alias("schema_version"), "file", "line", "col", "severity", F.struct(F.col("kind").alias("kind"), *own).alias("kind")))


def jsonl(findings: DataFrame) -> list[str]:
    return [r["j"] for r in findings.orderBy("file", "line", "kind").select(nested().alias("j")).toLocalIterator()]


def array(findings: DataFrame) -> str:
    return json.dumps([json.loads(x) for x in jsonl(findings)], indent=2)


def table(df: DataFrame, limit: int = 50) -> str:
    """A Markdown table of the first rows, and how many more there are."""
    rows, n = df.limit(limit).collect(), df.count()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    out = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]
    return "\n".join(out + ([f"…and {n - limit} more"] if n > limit else []))


def markdown(report: dict[str, DataFrame]) -> str:
    return "\n\n".join(f"## {name.capitalize()}\n\n{table(df)}" for name, df in report.items() if name != "findings") + "\n"


def dot(edges: DataFrame, name: str = "deps") -> str:
    lines = [f'  "{r["src"]}" -> "{r["dst"]}";' for r in edges.select("src", "dst").distinct().orderBy("src", "dst").collect()]
    return "\n".join([f"digraph {name} {{", *lines, "}"]) + "\n"
