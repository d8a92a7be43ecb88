"""Detectors and graph queries over small workspaces, with results worked out by hand."""

import pytest

from brindle.plans import cache
from brindle.plans.analysis import Analysis
from brindle.sources import rustparse
from brindle.sources.rustlex import LexError, lex


def workspace(root, crates, config=None, lock=None):
    """crates: {name: (files, dependency lines)}."""
    names = ", ".join(f'"{c}"' for c in crates)
    (root / "Cargo.toml").write_text(f'[workspace]\nresolver = "2"\nmembers = [{names}]\n')
    for name, (files, deps) in crates.items():
        for path, text in files.items():
            p = root / name / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
        (root / name / "Cargo.toml").write_text(f'[package]\nname = "{name}"\nversion = "0.1.0"\nedition = "2021"\n\n[dependencies]\n{deps}\n')
    if config:
        (root / ".brindle.json").write_text(config)
    if lock:
        (root / "Cargo.lock").write_text(lock)
    return root


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    a = """use serde::Serialize;

#[derive(Serialize)]
pub struct Kept {
    pub size: u32,
}

pub fn helper() -> Kept {
    Kept { size: 4 }
}

pub fn lonely() -> i32 {
    1
}

pub struct Orphan {
    pub x: i32,
}

#[cfg(test)]
mod tests {
    use super::*;
    #[test]
    fn works() {
        let _ = helper();
    }
}
"""
    b = 'use first_one::helper;\n\nfn main() {\n    let s = helper();\n    println!("{}", s.size);\n}\n'
    root = workspace(tmp_path_factory.mktemp("two"), {
        "first-one": ({"src/lib.rs": a}, 'serde = { version = "1", features = ["derive"] }\nspare = { package = "log", version = "0.4" }'),
        "second": ({"src/main.rs": b}, 'first-one = { path = "../first-one" }')})
    return Analysis(spark, root)


def col(df, name):
    return sorted(r[name] for r in df.collect())


def test_dead_code(two):
    assert [(r["symbol"], r["symbol_kind"], r["line"]) for r in two.dead_code().orderBy("line").collect()] == [("first_one::lonely", "fn", 12), ("first_one::Orphan", "struct", 16)]


def test_unused_deps(two):
    assert [(r["crate_name"], r["dep_name"], r["dep_kind"]) for r in two.unused_deps().collect()] == [("first-one", "log", "normal")]


def test_graph_queries(two):
    assert [(r["src"], r["dst"]) for r in two.crate_deps().collect()] == [("second", "first-one")]
    assert col(two.callers("first_one::helper"), "symbol") == ["first_one::Orphan", "second::main"]
    assert col(two.callees("first_one::helper"), "symbol") == ["first_one::Kept"]
    assert [r["distance"] for r in two.blast_radius("first_one::helper").collect()] == [1, 1]
    assert col(two.reverse_deps("first-one"), "from_crate") == ["second"]
    assert col(two.callers("first_one::nothing"), "symbol") == []


def test_ls_and_summary(two):
    assert col(two.ls("*::h*", "fn"), "qualified") == ["first_one::helper"]
    assert col(two.ls("", "struct"), "name") == ["Kept", "Orphan"]
    file = two.symbols.where("name = 'helper'").first()["file"]
    assert [(r["name"], r["signature"]) for r in two.summarize(file).collect()][:2] == [("Kept", "pub struct Kept"), ("helper", "pub fn helper() -> Kept")]


def test_context(two):
    c = two.context("helper")
    assert "Kept { size: 4 }" in c["definition"].first()["body"]
    # the reference inside mod tests has no function of its own there: the one before it counts
    assert col(c["callers"], "symbol") == ["first_one::lonely", "second::main"]
    assert [r["line"] for r in c["imports"].collect()][0] == "use serde::Serialize;"


def test_unused_features_and_report(two):
    assert two.deps_unused_features().collect() == []
    r = two.report()
    assert r["size"].first()["files"] == 2
    assert {x["kind"]: x["n"] for x in r["detectors"].collect()} == {"dead-code": 2, "unused-dep": 1}
    assert {x["state"]: x["count"] for x in two.diff(r["findings"].where("line <> 12")).groupBy("state").count().collect()} == {"introduced": 1, "unchanged": 2}
    assert two.audit(["first-one/src/lib.rs"]).count() == 3


def test_module_cycle_boundary_and_clones(spark, tmp_path):
    body = "{ let mut n = 0; for y in 0..9 { if y > 3 { n += y; } else { n -= 1; } } println!(\"{}\", n); n }"
    root = workspace(tmp_path, {
        "one": ({"src/lib.rs": "pub mod a;\npub mod b;\n", "src/a.rs": "use crate::b::beta;\npub fn alpha() -> i32 " + body + "\npub fn use_b() { beta(); }\n", "src/b.rs": "use crate::a::alpha;\npub fn beta() -> i32 " + body + "\npub fn use_a() { alpha(); other::gone(); }\n"}, 'two = { path = "../two" }'),
        "two": ({"src/lib.rs": "pub fn gone() {}\n"}, 'one = { path = "../one" }')},
        config='{"duplicates": {"min_tokens": 20}, "boundaries": [{"from": "one", "allow": [], "deny": ["other"]}]}',
        lock='[[package]]\nname = "serde"\nversion = "1.0.190"\nsource = "r"\n[[package]]\nname = "serde"\nversion = "1.0.219"\nsource = "r"\n[[package]]\nname = "app"\nversion = "0.1.0"\ndependencies = ["serde 1.0.190"]\n[[package]]\nname = "log"\nversion = "0.4.20"\nsource = "r"\ndependencies = ["serde 1.0.219"]\n')
    an = Analysis(spark, root)
    assert [(r["crate_name"], r["cycle"], r["severity"]) for r in an.module_cycles().collect()] == [("one", ["a", "b"], "warning")]
    assert [(r["cycle"], r["severity"]) for r in an.crate_cycles().collect()] == [(["one", "two"], "error")]
    assert {(r["to_path"], r["rule"]) for r in an.boundaries().collect()} == {("other::gone", "deny other")}
    assert [(r["symbol_a"], r["symbol_b"], r["similarity"]) for r in an.dupes().collect()] == [("one::alpha", "one::beta", 1.0)]
    assert [[m["symbol"] for m in r["members"]] for r in an.clone_clusters().collect()] == [["one::alpha", "one::beta"]]
    assert {(r["version"], tuple(r["callers"])) for r in an.deps_duplicates().collect()} == {("1.0.190", ("app@0.1.0",)), ("1.0.219", ("log@0.4.20",))}


def test_visibility(spark, tmp_path):
    root = workspace(tmp_path, {
        "one": ({"src/lib.rs": "pub mod deep;\nuse deep::inner_use;\npub fn local() {}\npub fn near() { local(); }\npub fn far() { inner_use(); }\n", "src/deep.rs": "pub fn inner_use() { crate::near(); }\n"}, ""),
        "two": ({"src/lib.rs": "use one::far;\nfn go() { far(); }\n"}, "")})
    got = {r["qualified"]: r["suggested"] for r in Analysis(spark, root).visibility().collect()}
    assert got == {"one::local": "private", "one::near": "pub_crate", "one::inner_use": "pub_crate"}


def parse(text):
    return rustparse.parse(text, "k", "a.rs")


def test_complexity():
    p = parse("fn big(x: i32) -> i32 {" + "".join(f" if x == {i} {{ return {i}; }}" for i in range(20)) + " 0 }")
    assert [(b["cyclo"], b["cog"]) for b in p.bodies] == [(21, 20)]
    p = parse("fn d(ys: Vec<i32>) { for y in ys { if y > 0 { match y { 0 => a(), _ => b() } } } }")
    assert [(b["cyclo"], b["cog"]) for b in p.bodies] == [(4, 6)]
    assert [(b["parent_id"], b["depth"], b["label"]) for b in p.branches] == [(-1, 0, "for y in ys"), (0, 1, "if"), (1, 2, "match")]
    p = parse("fn q(a: bool, b: &&str) -> Option<i32> { let f = || 1; let g = |x| x; foo::<T>()?; if a && b.is_empty() || g(a) { None } else if let Some(z) = c { z } else { None } }")
    assert p.bodies[0]["cyclo"] == 6


def test_lexer():
    kinds = [(t.kind, t.text) for t in lex("r#\"a\"b\"# 'x' 'life b'\\n' 1..2 0xFF_u8 1.5e3 /* a /* b */ c */ // end\n/// doc `it`\nr#type \"\\\"\"")]
    assert kinds == [("str", 'r#"a"b"#'), ("char", "'x'"), ("life", "'life"), ("char", "b'\\n'"), ("num", "1"), ("punct", "."), ("punct", "."), ("num", "2"), ("num", "0xFF_u8"), ("num", "1.5e3"), ("ident", "r#type"), ("str", '"\\""')]
    with pytest.raises(LexError):
        lex('"open')
    assert parse("fn a() { (] }") is None and parse("") is not None


def test_symbols_and_references():
    p = parse("pub(crate) const N: usize = 3;\nmod m { pub fn f() {} }\n#[no_mangle]\npub extern \"C\" fn c() {}\nimpl Show for Kind { fn show(&self) { fn inner() {} helper::deep::run(N); } }\nuse a::{b::c as d, e, self as s, f::*};\nfn g() { let x = format!(\"{N} {{no}} {w:?}\", y); x.len(); }\npub(super) struct P;\nstatic mut S: u8 = 0;\ntype T = u8;\n")
    sy = {s["qualified"]: (s["kind"], s["visibility"]) for s in p.symbols}
    assert sy == {"k::N": ("const", "pub_crate"), "k::m::f": ("fn", "public"), "k::c": ("fn", "public"), "k::inner": ("fn", "private"), "k::g": ("fn", "private"), "k::P": ("struct", "private"), "k::S": ("static", "private"), "k::T": ("type", "private")}
    assert next(s for s in p.symbols if s["name"] == "c")["has_no_mangle"] and next(s for s in p.symbols if s["name"] == "inner")["impl_of_foreign_trait"]
    r = {(x["name"], x["root"], x["is_path_segment"]) for x in p.refs}
    assert {("Show", None, False), ("Kind", None, False), ("run", "helper", False), ("deep", "helper", True), ("N", None, False), ("w", None, False), ("y", None, False), ("a", None, False), ("b", "a", False), ("c", "a", False), ("e", "a", False), ("f", "a", False)} <= r
    assert not {("no", None, False), ("len", None, False), ("d", "a", False)} & r


def test_cache(spark, tmp_path):
    files = spark.createDataFrame([("a", 1), ("b", 5), ("d", 1)], "path string, mtime long")
    cached = spark.createDataFrame([("a", 1, "x"), ("b", 4, "y"), ("c", 1, "z")], "path string, mtime long, name string")
    rows, p = cache.refresh(files, cached, lambda f: f.selectExpr("path", "mtime", "upper(path) as name"))
    assert {tuple(r) for r in rows.collect()} == {("a", 1, "x"), ("b", 5, "B"), ("d", 1, "D")}
    assert tuple(cache.counters(p).first()) == (1, 2, 1)
    cache.save(rows, str(tmp_path / "c"))
    assert cache.load(spark, str(tmp_path / "c")).count() == 3
    assert cache.load(spark, str(tmp_path / "c"), 99) is None
    (tmp_path / "d" / "v1").mkdir(parents=True)
    (tmp_path / "d" / "v1" / "x.parquet").write_text("garbage")
    assert cache.load(spark, str(tmp_path / "d")) is None


def test_files_are_parsed_once_and_kept(spark, tmp_path):
    import os

    (tmp_path / "w").mkdir()
    root = workspace(tmp_path / "w", {"one": ({"src/lib.rs": "pub fn used() {}\npub fn alone() {}\nfn go() { used(); }\n"}, ""), "two": ({"src/lib.rs": "pub fn other() {}\n"}, "")})
    kept = str(tmp_path / "cache")
    dead = lambda a: sorted(r["symbol"] for r in a.dead_code().collect())
    count = lambda a: tuple(cache.counters(a.ws.cache_plan).first())
    first = Analysis(spark, root, kept)
    want = dead(first)
    assert want == ["one::alone", "two::other"] and count(first) == (0, 2, 0)
    again = Analysis(spark, root, kept)
    assert dead(again) == want and count(again) == (2, 0, 0)
    (root / "two/src/lib.rs").write_text("pub fn newer() {}\n")
    os.utime(root / "two/src/lib.rs", (2_000_000_000, 2_000_000_000))
    third = Analysis(spark, root, kept)
    assert dead(third) == ["one::alone", "two::newer"] and count(third) == (1, 1, 0)


def test_manifests_inherit_and_have_targets(spark, tmp_path):
    root = workspace(tmp_path, {"one": ({"src/bin/tool.rs": "fn main() { serde::go(); }\n"}, 'serde = { workspace = true, features = ["rc"] }'), "skipped": ({"src/lib.rs": ""}, "")})
    (root / "Cargo.toml").write_text('[workspace]\nmembers = ["*"]\nexclude = ["skipped"]\n[workspace.dependencies]\nserde = { version = "1", features = ["derive"] }\n')
    with open(root / "one/Cargo.toml", "a") as f:
        f.write('[target."cfg(unix)".dependencies]\nnix = "0.2"\n')
    a = Analysis(spark, root)
    assert sorted((r["name"], r["kind"], tuple(r["features"])) for r in a.ws.deps().collect()) == [("nix", "normal", ()), ("serde", "normal", ("derive", "rc"))]
    assert [r["dep_name"] for r in a.unused_deps().collect()] == ["nix"]
