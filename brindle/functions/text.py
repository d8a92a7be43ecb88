"""Scalar functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

RESERVED = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while abstract become box do final macro override priv try typeof unsized virtual yield".split())


def qualified(crate: Column, module_path: Column, name: Column) -> Column:
    return F.concat_ws("::", crate, F.when(F.size(module_path) > 0, F.array_join(module_path, "::")), name)


def crate_key(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit("_"))


def leaf(path: Column) -> Column:
    return F.substring_index(path, "::", -1)


def root(path: Column) -> Column:
    return F.substring_index(path, "::", 1)


def glob_pattern(glob: str) -> str:
    """An anchored pattern: "*" is a run without "::", "**" anything; an empty glob matches all."""
    if not glob:
        return ".*"
    parts = re.split(r"(\*\*|\*)", glob)
    return "^" + "".join(".*" if p == "**" else "(?:(?!::).)*" if p == "*" else re.escape(p) for p in parts) + "$"


def glob(column: Column, pattern: str) -> Column:
    return column.rlike(glob_pattern(pattern))


def whole_word(word: str) -> str:
    return rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])"


def mentions(text: Column, word: str) -> Column:
    return text.rlike(whole_word(word))


def rename_word(text: Column, old: str, new: str) -> Column:
    return F.regexp_replace(text, whole_word(old), new.replace("\\", "\\\\").replace("$", "\\$"))


def count_word(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(whole_word(word)))


def is_identifier(name: Column) -> Column:
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~name.isin(*sorted(RESERVED))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lines(text: Column, start: int | Column, end: int | Column) -> Column:
    """Lines start..end (from 1, end included); nothing if either is 0 or start is past the end."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    all_ = F.split(text, "\n")
    return F.when((start <= 0) | (end < start) | (start > F.size(all_)), "").otherwise(F.array_join(F.slice(all_, start, end - start + 1), "\n"))


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: a newline at the end begins no further line."""
    n = F.regexp_count(text, F.lit("\n"))
    return F.when(F.length(text) == 0, 0).otherwise(n + F.when(text.endswith("\n"), 0).otherwise(1))


def module_of(path: Column, src_root: Column) -> Column:
    """The module a file stands for; "crate" for the root's own files and files outside."""
    inside = path.startswith(F.concat(src_root, F.lit("/")))
    rest = F.regexp_replace(F.substring(path, F.length(src_root) + 2, F.length(path)), r"\.rs$", "")
    rest = F.regexp_replace(rest, r"(^|/)(mod|lib|main)$", "")
    return F.when(~inside | (rest == ""), "crate").otherwise(F.replace(rest, F.lit("/"), F.lit("::")))


def relative(path: Column, workspace: str) -> Column:
    """A path below the workspace, or below its last folder of the same name."""
    name = workspace.rstrip("/").rsplit("/", 1)[-1]
    return F.when(path.startswith(workspace.rstrip("/") + "/"), F.substring(path, len(workspace.rstrip("/")) + 2, 1 << 30)).otherwise(F.regexp_replace(path, rf"^.*/{re.escape(name)}/", ""))


def shortstat(text: Column) -> Column:
    """files, insertions, deletions of a "diff --shortstat" line."""
    n = lambda p: F.coalesce(F.regexp_extract(text, p, 1).try_cast("int"), F.lit(0))
    return F.struct(n(r"(\d+) files? changed").alias("files"), n(r"(\d+) insertions?").alias("insertions"), n(r"(\d+) deletions?").alias("deletions"))


def path_prefixes(segments: Column) -> Column:
    """(pos, name, prefix) of the middle segments of a path of names."""
    at = F.sequence(F.lit(1), F.size(segments) - 2)
    each = F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(segments, i).alias("name"), F.slice(segments, F.lit(1), i + 1).alias("prefix")))
    return F.when(F.size(segments) > 2, each).otherwise(F.array().cast("array<struct<pos:int,name:string,prefix:array<string>>>"))


def format_names(literal: Column) -> Column:
    """Names that a format string refers to: {x} and {x:...}, but not {{."""
    bare = F.regexp_replace(literal, r"\{\{", "\u0001")
    return F.regexp_extract_all(bare, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)[:}]"), 1)


def drop_visibility(line: Column) -> Column:
    return F.regexp_replace(line, r"^(\s*)pub(\([^)]*\))?\s+", "$1")
