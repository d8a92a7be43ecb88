"""Findings, advisories and sizes from other tools' JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

_FINDING = "file string, path string, line int, k int, col int, kind string, category string, message string, severity string"


def findings(rows: DataFrame, column: str, line_keys: tuple[str, ...] = ("line",)) -> DataFrame:
    """``rows`` with file, line, col, kind, message and severity from a JSON object, with fallbacks; an
    object that can't be read gives the defaults."""
    j = F.from_json(column, _FINDING)
    return rows.withColumn("_j", j).select(
        *rows.columns, F.coalesce("_j.file", "_j.path", F.lit("")).alias("file"), F.coalesce(*(f"_j.{k}" for k in line_keys), F.lit(0)).alias("line"), F.coalesce("_j.col", F.lit(0)).alias("col"),
        F.coalesce("_j.kind", "_j.category", F.lit("")).alias("kind"), F.coalesce("_j.message", F.lit("")).alias("message"), F.coalesce("_j.severity", F.lit("warning")).alias("severity"))


def finding_lists(payloads: DataFrame, column: str) -> DataFrame:
    """One row per finding of payloads that are a list or {"findings": [...]}; broken payloads have none."""
    listed = F.from_json(column, f"array<struct<{_FINDING.replace(' string', ': string').replace(' int', ': int')}>>")
    nested = F.from_json(column, f"struct<findings: array<struct<{_FINDING.replace(' string', ': string').replace(' int', ': int')}>>>")["findings"]
    each = payloads.select(F.explode(F.when(F.ltrim(column).startswith("["), listed).otherwise(nested)).alias("j")).where("j is not null")
    return findings(each.select(F.to_json("j").alias("_json")), "_json").drop("_json")


def advisories(payloads: DataFrame, column: str) -> DataFrame:
    """(id, title, url, package, version) of an advisory report."""
    kind = "struct<vulnerabilities: struct<list: array<struct<advisory: struct<id: string, title: string, url: string>, package: struct<name: string, version: string>>>>>"
    v = payloads.select(F.explode(F.from_json(column, kind)["vulnerabilities"]["list"]).alias("v"))
    return v.select("v.advisory.id", "v.advisory.title", "v.advisory.url", F.col("v.package.name").alias("package"), "v.package.version")


def sizes(text: str) -> list[tuple[str, int]]:
    """(name, size) of a size report: the whole text, else its last line that can be read."""
    for part in [text, *reversed(text.splitlines())]:
        try:
            found = json.loads(part)["crates"]
            return [(str(c["name"]), int(c.get("size") or 0)) for c in found]
        except (ValueError, KeyError, TypeError):
            continue
    return []


def mapping(payloads: DataFrame, column: str) -> DataFrame:
    """(member, param, value) of a parameter mapping."""
    m = payloads.select(F.explode(F.from_json(column, "map<string, map<string, string>>")).alias("member", "params"))
    return m.select("member", F.explode("params").alias("param", "value"))
