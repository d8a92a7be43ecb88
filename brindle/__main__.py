"""python -m brindle COMMAND ROOT [TARGET]: the analyses of a workspace from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from brindle import render
from brindle.plans.analysis import Analysis

DETECTORS = {"dead-code": "dead_code", "unused-deps": "unused_deps", "dupes": "clone_clusters", "pairs": "dupes", "health": "health", "boundaries": "boundaries", "findings": "findings"}
ROWS = {"crate-deps": "crate_deps", "visibility": "visibility", "deps-duplicates": "deps_duplicates", "deps-unused-features": "deps_unused_features"}
TARGETED = {"callers": "callers", "callees": "callees", "blast-radius": "blast_radius", "reverse-deps": "reverse_deps", "ls": "ls", "summarize": "summarize", "branches": "branches"}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="brindle")
    p.add_argument("command", choices=[*DETECTORS, *ROWS, *TARGETED, "circular-deps", "report", "context"])
    p.add_argument("root")
    p.add_argument("target", nargs="?", default="")
    p.add_argument("--cache", help="a folder for parsed files; those that haven't changed aren't parsed again")
    p.add_argument("--format", choices=["human", "json", "jsonl", "md", "dot"], default="human")
    a = p.parse_args(argv)
    an = Analysis(SparkSession.builder.appName("brindle").getOrCreate(), a.root, a.cache)
    if a.command == "report":
        print(render.markdown(an.report()))
        return 0
    if a.command == "context":
        print(render.markdown(an.context(a.target)))
        return 0
    if a.command in DETECTORS or a.command == "circular-deps":
        found = an.crate_cycles().unionByName(an.module_cycles()) if a.command == "circular-deps" else getattr(an, DETECTORS[a.command])()
        lines = [render.array(found)] if a.format == "json" else render.jsonl(found) if a.format == "jsonl" else [render.table(found)] if a.format == "md" else [r["h"] for r in found.select(render.human().alias("h")).orderBy("h").collect()]
        print("\n".join(lines))
        return int(bool(lines and lines != ["[]"]))
    df = getattr(an, ROWS.get(a.command) or TARGETED[a.command])(*([a.target] if a.command in TARGETED else []))
    print(render.dot(df) if a.format == "dot" else render.table(df))
    return 0


if __name__ == "__main__":
    sys.exit(main())
