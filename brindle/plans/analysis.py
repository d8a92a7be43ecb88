"""The queries over a workspace's relations: what the command line and the library offer."""

from __future__ import annotations

from fractions import Fraction
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brindle.functions import text as T
from brindle.operators import detect, graph, packages, report, resolve, similarity
from brindle.sources.workspace import Workspace

FINDING = ["kind", "severity", "file", "line", "col", "symbol", "symbol_kind", "crate_name", "dep_name", "dep_kind", "cycle", "members", "symbol_a", "symbol_b", "similarity", "from_crate", "to_path", "rule", "cyclo", "cog", "source", "category", "message"]
_TYPES = {"line": "int", "col": "int", "cycle": "array<string>", "members": "array<struct<symbol:string,file:string,line:int>>", "similarity": "double", "cyclo": "int", "cog": "int"}


def finding(df: DataFrame, kind: str, severity: str) -> DataFrame:
    """Rows in the one wide schema of findings; columns a kind hasn't are null, line and col 0."""
    df = df.withColumn("kind", F.lit(kind)).withColumn("severity", F.lit(severity))
    own = lambda c: F.col(c) if c in df.columns else F.lit(0) if c in ("line", "col") else F.lit(None)
    return df.select(*(own(c).cast(_TYPES.get(c, "string")).alias(c) for c in FINDING))


class Analysis:
    """Relations are written once and shared by all queries."""

    def __init__(self, spark: SparkSession, root: str | Path, cache_dir: str | None = None):
        self.spark, self.ws = spark, Workspace(spark, root, cache_dir)
        self.config = self.ws.config

    @cached_property
    def symbols(self) -> DataFrame:
        return graph.written(self.ws.symbols(), "symbols")

    @cached_property
    def refs(self) -> DataFrame:
        return graph.written(self.ws.refs(), "refs")

    @cached_property
    def bodies(self) -> DataFrame:
        return graph.written(self.ws.bodies(), "bodies")

    @cached_property
    def edges(self) -> DataFrame:
        """The call graph, worked out once for all traversals."""
        return graph.written(resolve.call_edges(self.refs, self.symbols), "edges")

    # -- detectors ---------------------------------------------------------------------------------

    def dead_code(self) -> DataFrame:
        dead = detect.dead_items(self.symbols, self.refs, self.config.allow_dead)
        return finding(dead.select("file", "line", "col", F.col("qualified").alias("symbol"), F.col("kind").alias("symbol_kind"), "crate_name"), "dead-code", "warning")

    def unused_deps(self) -> DataFrame:
        unused = detect.unused_deps(self.ws.deps(), self.refs, self.config.allow_unused_deps)
        return finding(unused.select(F.col("manifest_path").alias("file"), F.col("crate").alias("crate_name"), F.col("name").alias("dep_name"), F.col("kind").alias("dep_kind")), "unused-dep", "warning")

    def crate_cycles(self) -> DataFrame:
        e = packages.crate_edges(self.ws.deps(), self.ws.crates()).select("src", "dst")
        found = graph.cycles(e).groupBy("comp").agg(F.array_sort(F.collect_list("node")).alias("cycle"))
        first = self.ws.crates().select(F.col("name").alias("comp"), F.col("manifest_path").alias("file"))
        return finding(found.join(F.broadcast(first), "comp"), "circular-dep", "error")

    def module_of_files(self) -> DataFrame:
        roots = self.ws.crates().select(F.col("crate_key").alias("_crate"), F.regexp_replace(F.get("src_paths", F.lit(0)), "/[^/]*$", "").alias("_root"))
        files = self.symbols.select(F.col("crate_name").alias("_crate"), F.col("file").alias("_file")).union(self.refs.select("from_crate", "from_file")).distinct()
        return files.join(F.broadcast(roots), "_crate").select("_crate", "_file", T.module_of(F.col("_file"), F.col("_root")).alias("module"))

    def module_edges(self) -> DataFrame:
        m = self.module_of_files()
        s = self.symbols.join(m, (F.col("file") == F.col("_file")) & (F.col("crate_name") == F.col("_crate"))).select(F.col("crate_name").alias("crate"), "module", "name")
        inner = F.filter("segments", lambda x: ~x.isin("crate", "self", "super"))
        prefix = F.array_join(F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0))), "::")
        r = self.refs.where("not is_path_segment").join(m, (F.col("from_file") == F.col("_file")) & (F.col("from_crate") == F.col("_crate")))
        r = r.select(F.col("from_crate").alias("crate"), F.col("module").alias("from_module"), "name", "root", prefix.alias("prefix"))
        return packages.module_edges(r, s)

    def module_cycles(self) -> DataFrame:
        found = graph.cycles(self.module_edges(), "crate").groupBy("crate", "comp").agg(F.array_sort(F.collect_list("node")).alias("cycle"))
        return finding(found.withColumnRenamed("crate", "crate_name"), "circular-dep", "warning")

    def _threshold(self) -> tuple[int, int]:
        f = Fraction(str(self.config.similarity_threshold))
        return f.numerator, f.denominator

    def dupes(self, min_tokens: int | None = None) -> DataFrame:
        """Pairs of near-duplicate functions."""
        pairs = similarity.similar_pairs(self.bodies.where("not is_test"), min_tokens or self.config.min_tokens, self._threshold())
        at = self.bodies.select(F.col("fn_id").alias("a"), "file", "line", "col")
        # one row for each two names, whichever comes first by place: that of the least ids
        named = pairs.select(F.least("qa", "qb").alias("symbol_a"), F.greatest("qa", "qb").alias("symbol_b"), "a", "b", (F.col("inter") / F.col("uni")).alias("similarity"))
        one = named.groupBy("symbol_a", "symbol_b").agg(F.min(F.struct("a", "b", "similarity")).alias("p"))
        both = one.select("symbol_a", "symbol_b", "p.a", "p.similarity").join(at, "a")
        return finding(both.select("file", "line", "col", "symbol_a", "symbol_b", "similarity"), "duplicate", "warning")

    def clone_clusters(self, min_tokens: int | None = None) -> DataFrame:
        c = similarity.clusters(self.bodies.where("not is_test"), min_tokens or self.config.min_tokens, self._threshold())
        each = c.select("comp", "max_similarity", F.explode("members").alias("fn_id")).join(self.bodies.select("fn_id", "qualified", "file", "line"), "fn_id")
        # of members of one name the first by place stays
        one = each.groupBy("comp", "max_similarity", "qualified").agg(F.min(F.struct("file", "line")).alias("at"))
        m = one.groupBy("comp", "max_similarity").agg(F.array_sort(F.collect_list(F.struct(F.col("qualified").alias("symbol"), F.col("at.file").alias("file"), F.col("at.line").alias("line")))).alias("members")).where(F.size("members") >= 2)
        first = F.get("members", F.lit(0))
        return finding(m.select("members", F.col("max_similarity").alias("similarity"), first["file"].alias("file"), first["line"].alias("line")), "duplicate-cluster", "warning")

    def health(self, cyclomatic: int | None = None, cognitive: int | None = None) -> DataFrame:
        hot = detect.hotspots(self.bodies.where("not is_test"), cyclomatic or self.config.cyclomatic, cognitive or self.config.cognitive)
        return finding(hot.select("file", "line", "col", F.col("qualified").alias("symbol"), "crate_name", "cyclo", "cog"), "complexity", "warning")

    def branches(self, target: str) -> DataFrame:
        """The tree of branches of the first function a name means, as rows."""
        b = self.ws.branches()
        leaf = F.substring_index("qualified", "::", -1)
        mine = b.where((F.col("qualified") == target) | F.col("qualified").endswith("::" + target) | (leaf == target))
        first = mine.orderBy("file", "line").select("qualified", "file").limit(1)
        return mine.join(F.broadcast(first), ["qualified", "file"], "left_semi").orderBy("node_id")

    def boundaries(self) -> DataFrame:
        outside = self.refs.where("root is not null and root not in ('crate', 'self', 'super', 'Self', 'std', 'core', 'alloc')")
        crates = self.ws.crates().select(F.col("crate_key").alias("from_crate"), "name", F.expr(f"substring(root_dir, {len(str(self.ws.root)) + 2})").alias("from_path"))
        r = outside.withColumn("path", F.concat_ws("::", "root", "name")).drop("name").join(F.broadcast(crates), "from_crate").withColumnRenamed("name", "crate")
        hit = detect.boundary_violations(r, self.config.rules(self.spark), scope=(F.col("from") == F.col("crate")) | F.col("from_path").startswith(F.col("from")))
        return finding(hit.select(F.col("from_file").alias("file"), "line", F.col("crate").alias("from_crate"), F.col("path").alias("to_path"), "rule"), "boundary", "error")

    def visibility(self) -> DataFrame:
        """(symbol_id, qualified, visibility, suggested, n_refs)."""
        s = self.symbols.withColumn("_k", F.count("*").over(Window.partitionBy("name")))
        flags = " and ".join(f"not {c}" for c in detect.EXEMPT)
        own = s.where(f"visibility <> 'private' and {flags}").select("symbol_id", "visibility", "crate_name", F.col("name").alias("_own"), "file", F.col("line").alias("_line"), "_k")
        own = own.join(self.reexports(), F.col("_own") == F.col("_reexport"), "left_anti")
        r = self.refs.where("not is_path_segment").withColumnRenamed("line", "_at")
        hit = resolve.visibility_uses(own, r).where(~((F.col("from_file") == F.col("file")) & (F.col("_at") == F.col("_line"))))
        uses = hit.select("symbol_id", "visibility", (F.col("from_file") == F.col("file")).alias("same_file"), (F.col("from_crate") == F.col("crate_name")).alias("same_crate"))
        return detect.visibility_suggestions(uses).join(self.symbols.select("symbol_id", "qualified", "file", "line"), "symbol_id")

    def reexports(self) -> DataFrame:
        """(_reexport): names that files use publicly; an alias counts in place of the name."""
        body = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)\bpub(?:\(crate\))?\s+use\s+([^;]*);"), 1))
        piece = self.ws.files().select(body.alias("b")).select(F.explode(F.split("b", r"[{},]")).alias("p")).select(F.trim("p").alias("p")).where("p <> '' and p not like '%*'")
        alias = F.regexp_extract("p", r"\bas\s+(\w+)\s*$", 1)
        return piece.select(F.when(alias != "", alias).otherwise(F.substring_index("p", "::", -1)).alias("_reexport")).where("_reexport <> ''").distinct()

    # -- graph ---------------------------------------------------------------------------------------

    def callers(self, target: str, transitive: bool = False, depth: int | None = None) -> DataFrame:
        e = self.edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
        return self._reach(e, target, None if transitive or depth else 1, depth)

    def callees(self, target: str, transitive: bool = False) -> DataFrame:
        return self._reach(self.edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), target, None if transitive else 1, None)

    def blast_radius(self, target: str, depth: int | None = None) -> DataFrame:
        return self.callers(target, True, depth)

    def _reach(self, edges: DataFrame, target: str, most: int | None, depth: int | None) -> DataFrame:
        start = resolve.resolve_symbol(self.symbols, target).select(F.col("symbol_id").alias("node"))
        found = graph.bfs(edges, start, depth or most)
        s = self.symbols.select(F.col("symbol_id").alias("node"), F.col("qualified").alias("symbol"), "file", "line")
        return found.join(s, "node").select("symbol", "file", "line", "distance").orderBy("distance", "symbol")

    def crate_deps(self) -> DataFrame:
        return packages.crate_edges(self.ws.deps(), self.ws.crates())

    def reverse_deps(self, target: str) -> DataFrame:
        key = target.replace("-", "_")
        if self.ws.crates().where(F.col("crate_key") == key).take(1):
            return packages.reverse_crate_deps(self.refs, self.symbols, key).orderBy("from_crate")
        inside = self.symbols.where((F.col("qualified") == target) | F.col("qualified").startswith(target + "::"))
        return resolve.referring_crates(self.refs, inside).orderBy("from_crate")

    # -- navigation ------------------------------------------------------------------------------------

    def ls(self, pattern: str = "", kind: str | None = None) -> DataFrame:
        s = self.symbols.where("not is_test")
        s = s.where(F.col("kind") == kind) if kind else s
        return s.where(T.glob(F.col("qualified"), pattern) | T.glob(F.col("name"), pattern)).orderBy("qualified", "symbol_id")

    def context(self, target: str, limit: int = 5) -> dict[str, DataFrame]:
        """definition (with its text), imports, callers, callees of a symbol."""
        s = self.symbols
        leaf = target.rsplit("::", 1)[-1]
        found = s.where((F.col("qualified") == target) | F.col("qualified").endswith("::" + target) | (F.col("name") == leaf)).withColumn("_r", (F.col("qualified") != target).cast("int")).orderBy("_r", "symbol_id").limit(1).drop("_r")
        one = graph.written(found, "target")
        files = self.ws.files().join(F.broadcast(one.select(F.col("file").alias("path"), "line", "line_end")), "path")
        names = s.select(F.col("symbol_id").alias("_id"), F.col("qualified").alias("symbol"), "file", "line")
        callers = resolve.context_callers(self.refs, s, limit).join(F.broadcast(one.select(F.col("symbol_id").alias("target_id"))), "target_id", "left_semi")
        callees = resolve.context_callees(self.refs, s, limit).join(F.broadcast(one.select(F.col("symbol_id").alias("caller_id"))), "caller_id", "left_semi")
        return {
            "definition": one.join(files.select(F.col("path").alias("file"), T.lines(F.col("text"), F.col("line"), F.col("line_end")).alias("body")), "file"),
            "imports": files.select(F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.ltrim(x).rlike("^(pub )?use "))).alias("pos", "line")).orderBy("pos"),
            "callers": callers.join(names, F.col("caller_id") == F.col("_id")).select("rank", "symbol", "file", "line").orderBy("rank"),
            "callees": callees.join(names, F.col("callee_id") == F.col("_id")).select("rank", "symbol", "file", "line").orderBy("rank"),
        }

    def summarize(self, file: str) -> DataFrame:
        """Visible items of a file, with signatures and complexity."""
        s = self.symbols.where((F.col("file") == file) & (F.col("visibility") != "private"))
        b = self.bodies.select(F.col("file").alias("_f"), F.col("line").alias("_l"), "cyclo", "cog")
        return s.join(b, (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l")), "left").select("kind", "name", "signature", "line", "cyclo", "cog").orderBy("line")

    # -- packages ---------------------------------------------------------------------------------------

    def deps_duplicates(self) -> DataFrame:
        lock = self.ws.lock()
        return packages.duplicate_versions(lock.where("source is not null").select("name", "version"), packages.lock_callers(lock)).orderBy("name", "version")

    def deps_unused_features(self) -> DataFrame:
        """(crate, dep, feature) whose feature's and dependency's names no source of the crate has."""
        d = self.ws.deps().select("crate", "crate_key", F.col("name").alias("dep"), F.explode("features").alias("feature")).withColumn("local", T.crate_key(F.col("dep")))
        f = self.ws.files().select(F.col("crate_key").alias("_c"), "text")
        used = F.contains("text", F.col("feature")) | F.contains("text", F.concat("local", F.lit("::"))) | F.contains("text", F.concat(F.lit("use "), "local"))
        hit = f.join(F.broadcast(d), F.col("_c") == F.col("crate_key")).where(used).select("crate", "dep", "feature").distinct()
        return d.select("crate", "dep", "feature").join(hit, ["crate", "dep", "feature"], "left_anti")

    # -- composites --------------------------------------------------------------------------------------

    def findings(self) -> DataFrame:
        out = self.dead_code()
        for f in (self.unused_deps, self.crate_cycles, self.module_cycles, self.clone_clusters, self.health, self.boundaries):
            out = out.unionByName(f())
        return out

    def audit(self, changed: list[str]) -> DataFrame:
        """Dead code and unused dependencies of the crates of changed files; all if none has one."""
        c = self.spark.createDataFrame([(str(self.ws.root / p),) for p in dict.fromkeys(changed)], "path string")
        owners = self.ws.crates().select("root_dir", "crate_ord", F.col("crate_key").alias("crate_name"))
        impacted = detect.first_prefix(c, owners, "path", "root_dir", "crate_ord", ["path"])
        both = self.dead_code().unionByName(self.unused_deps().withColumn("crate_name", T.crate_key(F.col("crate_name"))))
        return detect.scoped(both, impacted.select("crate_name"), "crate_name")

    def report(self) -> dict[str, DataFrame]:
        f = graph.written(self.findings(), "findings")
        size = self.ws.files().agg(F.count("*").alias("files"), F.sum(T.line_count(F.col("text"))).alias("loc"))
        return {"size": size, "detectors": report.by_detector(f), "severities": report.by_severity(f), "files": report.top_files(f), "complexity": report.top_complexity(f.where("kind = 'complexity'"), "symbol"), "clusters": report.top_clusters(f), "fixable": report.fixable(f), "findings": f}

    def diff(self, base: DataFrame) -> DataFrame:
        """This workspace's findings against an older snapshot's."""
        return report.snapshot_diff(report.identity(base), report.identity(self.findings()))
