"""A workspace as relations: crates, dependencies, files, lock packages, configuration.

Manifests are few and small: they are read in the driver.  Sources are read by Spark, a file a row.
"""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brindle.operators.graph import written
from brindle.plans import cache
from brindle.sources import rustparse

CRATES = "name string, crate_key string, manifest_path string, root_dir string, src_paths array<string>, crate_ord int"
DEPS = "crate string, crate_key string, name string, rename string, kind string, optional boolean, features array<string>, manifest_path string, dep_ord int"
LOCK = "name string, version string, source string, dependencies array<string>"


@dataclass
class Config:
    """Thresholds and exceptions, from a JSON file; what it leaves out has these defaults."""

    allow_dead: list[str] = field(default_factory=list)
    allow_unused_deps: list[str] = field(default_factory=list)
    min_tokens: int = 40
    similarity_threshold: float = 0.85
    cyclomatic: int = 15
    cognitive: int = 25
    boundaries: list[dict] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        path = Path(path)
        if not path.exists():
            return cls()
        raw = json.loads(path.read_text())
        dup, com = raw.get("duplicates", {}), raw.get("complexity", {})
        return cls(raw.get("allow_dead", []), raw.get("allow_unused_deps", []), dup.get("min_tokens", 40), dup.get("similarity_threshold", 0.85), com.get("cyclomatic", 15), com.get("cognitive", 25), raw.get("boundaries", []))

    def rules(self, spark: SparkSession) -> DataFrame:
        rows = [(i, b["from"], b.get("allow", []), b.get("deny", [])) for i, b in enumerate(self.boundaries)]
        return spark.createDataFrame(rows, "rule_ord int, from string, allow array<string>, deny array<string>")

    def with_imports(self, clippy: dict | None = None, deny: dict | None = None) -> Config:
        """Takes over a cognitive threshold and skipped crates from other tools' configuration."""
        if clippy and "cognitive-complexity-threshold" in clippy:
            self.cognitive = clippy["cognitive-complexity-threshold"]
        for skip in ((deny or {}).get("bans") or {}).get("skip", []):
            if skip.get("name") and skip["name"] not in self.allow_unused_deps:
                self.allow_unused_deps.append(skip["name"])
        return self


def members(root: str | Path) -> list[Path]:
    """Manifests of a workspace's members, in their order; of a package alone, its own."""
    root = Path(root)
    top = tomllib.loads((root / "Cargo.toml").read_text())
    found = [root / "Cargo.toml"] if "package" in top else []
    own = top.get("workspace", {})
    for pattern in own.get("members", []):
        found += sorted(p / "Cargo.toml" for p in root.glob(pattern) if (p / "Cargo.toml").exists())
    out = {p.parent for pattern in own.get("exclude", []) for p in root.glob(f"{pattern.rstrip('/')}/Cargo.toml")}
    return [p for p in dict.fromkeys(found) if p.parent not in out]


_SECTIONS = (("dependencies", "normal"), ("dev-dependencies", "dev"), ("build-dependencies", "build"))


def manifest_deps(m: dict, top: dict):
    """(name, spec, kind) of a manifest's dependencies, those of its targets too, each kind and name once.  A spec that
    says ``workspace = true`` inherits the workspace's, and adds its own features."""
    shared, seen = top.get("workspace", {}).get("dependencies", {}), set()
    for part in (m, *m.get("target", {}).values()):
        for section, kind in _SECTIONS:
            for name, spec in part.get(section, {}).items():
                spec = spec if isinstance(spec, dict) else {}
                if spec.get("workspace"):
                    base = shared.get(name, {})
                    base = base if isinstance(base, dict) else {}
                    spec = base | spec | {"features": [*base.get("features", []), *spec.get("features", [])]}
                if (kind, name) not in seen:
                    seen.add((kind, name))
                    yield name, spec, kind


def _targets(folder: Path, m: dict) -> list[str]:
    out = []
    lib = m.get("lib", {}).get("path", "src/lib.rs")
    out += [lib] if (folder / lib).exists() else []
    bins = [b.get("path", f"src/bin/{b.get('name')}.rs") for b in m.get("bin", [])]
    out += bins or (["src/main.rs"] if (folder / "src/main.rs").exists() else [])
    out += sorted(str(p.relative_to(folder)) for p in (folder / "src/bin").glob("*.rs"))
    for extra in ("tests", "benches", "examples"):
        out += sorted(str(p.relative_to(folder)) for p in (folder / extra).glob("*.rs"))
    out += ["build.rs"] if (folder / "build.rs").exists() else []
    return [str(folder / p) for p in dict.fromkeys(out)]


class Workspace:
    def __init__(self, spark: SparkSession, root: str | Path, cache_dir: str | None = None):
        self.spark, self.root, self.cache_dir, self.cache_plan = spark, Path(root).resolve(), cache_dir, None
        self.config = Config.load(self.root / ".brindle.json")
        self.manifests = [(p, tomllib.loads(p.read_text())) for p in members(self.root)]

    def crates(self) -> DataFrame:
        rows = [(m["package"]["name"], m["package"]["name"].replace("-", "_"), str(p), str(p.parent), _targets(p.parent, m), i) for i, (p, m) in enumerate(self.manifests)]
        return self.spark.createDataFrame(rows, CRATES)

    def deps(self) -> DataFrame:
        rows, top = [], tomllib.loads((self.root / "Cargo.toml").read_text())
        for p, m in self.manifests:
            crate = m["package"]["name"]
            for name, spec, kind in manifest_deps(m, top):
                real = spec.get("package", name)
                rows.append((crate, crate.replace("-", "_"), real, name if real != name else None, kind, bool(spec.get("optional", False)), list(spec.get("features", [])), str(p), len(rows)))
        return self.spark.createDataFrame(rows, DEPS)

    def _sources(self, paths: list[str]) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").load(paths)

    def listing(self) -> DataFrame:
        """(path, crate_key, crate_ord, mtime) of the sources below the folders of crates' targets; no text is read."""
        crates = self.crates()
        raw = self._sources([str(p.parent) for p, _ in self.manifests]).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.unix_timestamp("modificationTime").alias("mtime")).distinct()
        folders = crates.select("crate_key", "crate_ord", F.explode("src_paths").alias("s")).select("crate_key", "crate_ord", F.regexp_replace("s", "/[^/]*$", "").alias("dir")).distinct()
        # a file's folders, each joined by equality
        steps = F.split("path", "/")
        up = raw.select("path", "mtime", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("dir"))
        both = up.join(folders, "dir").withColumn("_near", F.struct(-F.length("dir"), "crate_ord"))
        return both.groupBy("path").agg(F.min_by("crate_key", "_near").alias("crate_key"), F.min_by("crate_ord", "_near").alias("crate_ord"), F.max("mtime").alias("mtime"))

    def files(self, owners: DataFrame | None = None) -> DataFrame:
        """(path, crate_key, crate_ord, mtime, text): owners are settled on paths alone, and texts don't move if the owners
        are few enough to be broadcast."""
        raw = self._sources([str(p.parent) for p, _ in self.manifests]).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.decode("content", "UTF-8").alias("text"))
        nested = any(a != b and a.parent in b.parent.parents for a, _ in self.manifests for b, _ in self.manifests)
        raw = raw.dropDuplicates(["path"]) if nested else raw  # folders inside others are listed twice
        return raw.join(self.listing() if owners is None else owners, "path")

    @cached_property
    def parsed(self) -> DataFrame:
        """(path, mtime, crate_key, symbols, refs, bodies, branches), a row per file: each file is parsed once for all four.
        With a cache folder, files that are no newer than their cached rows aren't read again."""
        kept = [F.col(c) for c in ("path", "mtime", "crate_key", *rustparse.KINDS)]
        parse = lambda owners: rustparse.extract_all(self.files(owners)).select(*kept)
        known = cache.load(self.spark, self.cache_dir) if self.cache_dir else None
        now = written(self.listing(), "listing")
        if known is None:
            rows, self.cache_plan = written(parse(now), "parsed"), now.select("path", F.lit("miss").alias("state"))
        else:
            # a file that went to another crate is parsed again
            known = known.join(now.select("path", "crate_key"), ["path", "crate_key"], "left_semi").select(*kept)
            rows, self.cache_plan = cache.refresh(now, known, parse)
            rows = written(rows, "parsed")
        if self.cache_dir and self.cache_plan.where("state <> 'hit'").take(1):
            self.cache_plan = written(self.cache_plan, "cache-plan")
            cache.save(rows, self.cache_dir)
        return rows

    def _relation(self, kind: str) -> DataFrame:
        return self.parsed.select(F.explode(kind).alias("r")).select("r.*")

    def symbols(self) -> DataFrame:
        """Symbols with ids in the order of crates, files and places."""
        return _numbered(self._relation("symbols"), "symbol_id", "file", self.crates(), "crate_name")

    def refs(self) -> DataFrame:
        return _numbered(self._relation("refs"), "ref_id", "from_file", self.crates(), "from_crate")

    def bodies(self) -> DataFrame:
        return _numbered(self._relation("bodies"), "fn_id", "file", self.crates(), "crate_name")

    def branches(self) -> DataFrame:
        return self._relation("branches")

    def lock(self) -> DataFrame:
        path = self.root / "Cargo.lock"
        found = tomllib.loads(path.read_text()).get("package", []) if path.exists() else []
        return self.spark.createDataFrame([(p["name"], p["version"], p.get("source"), p.get("dependencies", [])) for p in found], LOCK)


def _numbered(rows: DataFrame, name: str, file: str, crates: DataFrame, crate: str) -> DataFrame:
    """Ids that follow (crate order, file, place in the file): files are ranked, and a file's first id is the number of rows of
    the files before, so no global sort of the rows is needed and ids never collide."""
    from pyspark.sql import Window

    order = rows.groupBy(file, crate).agg((F.max("ord") + 1).alias("_n")).join(F.broadcast(crates.select(F.col("crate_key").alias(crate), "crate_ord")), crate)
    before = F.sum("_n").over(Window.orderBy("crate_ord", file).rowsBetween(Window.unboundedPreceding, -1))
    rank = order.withColumn("_first", F.coalesce(before, F.lit(0))).select(file, "_first")
    return rows.join(rank, file).withColumn(name, (F.col("_first") + F.col("ord") + 1).cast("long")).drop("_first", "ord")
