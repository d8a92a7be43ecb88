"""Rust files as rows: symbols, references, function bodies with their complexity, branches.

The front end works on tokens and finds items, paths, macros and control flow by their syntax; it does
not check types.  A file whose tokens don't pair up gives no rows, as one that can't be parsed.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.sources.rustlex import LexError, Tok, lex, match_groups

SYMBOL = "crate_name string, module_path array<string>, name string, qualified string, kind string, visibility string, file string, line int, col int, line_end int, signature string, is_test boolean, is_entry_point boolean, has_no_mangle boolean, has_export_name boolean, impl_of_foreign_trait boolean, ord int"
REF = "from_file string, from_crate string, name string, root string, segments array<string>, is_path_segment boolean, line int, ord int"
BODY = "crate_name string, qualified string, name string, file string, line int, col int, tokens array<string>, raw array<string>, cyclo int, cog int, is_test boolean, ord int"
BRANCH = "qualified string, file string, node_id int, parent_id int, ord int, depth int, label string, line int"

PRIMITIVE = frozenset("bool char str u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 Self self _".split())
KEPT = frozenset("if else match for while loop return break continue let mut ref fn as in move async await self Self true false unsafe where".split())
STRICT = frozenset("as break const continue else enum extern false fn for if impl in let loop match mod move mut pub ref return static struct trait true type unsafe use where while async await dyn".split())
ITEMS = {"fn": "fn", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "const", "static": "static"}
_FORMAT = re.compile(r"\{([^\W\d]\w*)(?=[:}])")


class Parser:
    def __init__(self, text: str, crate: str, file: str):
        self.crate, self.file = crate, file
        self.t: list[Tok] = lex(text)
        self.end = match_groups(self.t)
        self.lines = text.split("\n")
        self.symbols: list[dict] = []
        self.refs: list[dict] = []
        self.bodies: list[dict] = []
        self.branches: list[dict] = []
        self.items(0, len(self.t), (), False, False, False)

    # -- helpers ---------------------------------------------------------------------------------

    def is_(self, i: int, text: str) -> bool:
        return i < len(self.t) and self.t[i].text == text

    def two(self, i: int, text: str) -> bool:
        return self.is_(i, text[0]) and self.t[i].joint and self.is_(i + 1, text[1])

    def ref(self, segments: list[str], line: int, use: bool = False) -> None:
        """A path: its last name, and the names in the middle."""
        last = segments[-1]
        if last in PRIMITIVE and not use:
            return
        self._ref(last, segments[0] if len(segments) > 1 else None, segments, False, line)
        if not use:
            for k in range(1, len(segments) - 1):
                if segments[k] not in PRIMITIVE:
                    self._ref(segments[k], segments[0], segments[: k + 1], True, line)

    def _ref(self, name, root, segments, middle, line):
        self.refs.append({"from_file": self.file, "from_crate": self.crate, "name": name, "root": root, "segments": list(segments), "is_path_segment": middle, "line": line, "ord": len(self.refs)})

    # -- items -----------------------------------------------------------------------------------

    def attributes(self, i: int) -> tuple[int, list[tuple[str, str]]]:
        """Attributes from ``i`` on: (path, text inside); their names are references."""
        found = []
        while self.is_(i, "#"):
            j = i + 2 if self.is_(i + 1, "!") else i + 1
            if not self.is_(j, "["):
                break
            close = self.end[j]
            path, k = [], j + 1
            while k < close and self.t[k].kind == "ident":
                path.append(self.t[k].text)
                if not self.two(k + 1, "::"):
                    k += 1
                    break
                k += 3
            inside = " ".join(x.text for x in self.t[k:close])
            if path:
                found.append(("::".join(path), inside))
                if path == ["derive"]:
                    names = [""]
                    for x in self.t[k + 1 : close - 1]:
                        names = [*names, ""] if x.text == "," else [*names[:-1], x.text] if x.kind == "ident" else names
                    for name in names:
                        if name:
                            self._ref(name, None, [name], False, self.t[i].line)
                self.ref(path, self.t[j].line)
            i = close + 1
        return i, found

    def visibility(self, i: int) -> tuple[int, str]:
        if not self.is_(i, "pub"):
            return i, "private"
        if self.is_(i + 1, "(") and self.t[i + 2].text in ("crate", "super", "self", "in"):
            inside = self.t[i + 2].text
            self.paths(i + 2, self.end[i + 1])
            return self.end[i + 1] + 1, "pub_crate" if inside == "crate" else "private"
        return i + 1, "public"

    def items(self, i: int, stop: int, path: tuple, tests: bool, foreign: bool, in_impl: bool) -> None:
        """Items of a file, an inline module or an impl (whose own functions are no symbols)."""
        while i < stop:
            i = self.item(i, stop, path, tests, foreign, in_impl)

    def item(self, i: int, stop: int, path: tuple, tests: bool, foreign: bool, in_impl: bool, method: bool = False) -> int:
        begin = i
        i, attrs = self.attributes(i)
        if i >= stop:
            return stop
        i, vis = self.visibility(i)
        k = i
        while k < stop and self.t[k].text in ("unsafe", "async", "extern", "default", "const") and (self.t[k].text != "const" or self.t[k + 1].text in ("fn", "unsafe", "async", "extern")):
            if self.is_(k, "extern") and self.is_(k + 1, "crate"):
                break
            k += 2 if self.is_(k, "extern") and k + 1 < stop and self.t[k + 1].kind == "str" else 1
        if k >= stop:
            return stop
        word = self.t[k].text
        named = k + 1 < stop and self.t[k + 1].kind == "ident"
        if word == "fn" and named:
            return self.function(begin, k, stop, attrs, vis, path, tests, foreign, in_impl, method)
        if word in ("static", "const") and self.is_(k + 1, "mut"):
            k, named = k + 1, True
        if word in ITEMS and named and not method or word == "union" and named and self.t[k + 2].text in ("{", "<") and not method:
            return self.plain(k, stop, word, attrs, vis, path, tests, foreign, in_impl)
        if word == "mod" and named:
            if self.is_(k + 2, ";"):
                return k + 3
            if self.is_(k + 2, "{"):
                name = self.t[k + 1].text
                hidden = name == "tests" or any(p == "cfg" and "test" in x or p == "cfg_attr" for p, x in attrs)
                self.items(k + 3, self.end[k + 2], (*path, name), tests or hidden, foreign, in_impl)
                return self.end[k + 2] + 1
        if word == "use":
            j = self.until(k, stop, ";")
            self.use(k + 1, j, [], self.t[i].line if vis == "private" else self.t[begin if not attrs else i].line)
            return j + 1
        if word == "impl":
            return self.impl(k, stop, path, tests)
        if word == "extern" and self.is_(k + 1, "crate"):
            return self.until(k, stop, ";") + 1
        if self.is_(k, "{"):  # extern blocks
            self.items(k + 1, self.end[k], path, True, foreign, in_impl)
            return self.end[k] + 1
        if word == "macro_rules" and self.is_(k + 1, "!"):
            j = k + 2 if self.t[k + 2].kind == "open" else k + 3
            self.macro(["macro_rules"], self.t[k].line, j)
            return self.end[j] + (2 if self.is_(self.end[j] + 1, ";") else 1)
        # anything else (macro calls, associated consts and types): paths up to its end
        j = k
        while j < stop and not self.is_(j, ";") and not self.is_(j, "{"):
            j = self.end[j] + 1 if self.t[j].kind == "open" else j + 1
        j = self.end[j] + 1 if j < stop and self.is_(j, "{") else min(j + 1, stop)
        self.paths(i, j)
        return max(j, begin + 1)

    def until(self, i: int, stop: int, text: str) -> int:
        while i < stop and not self.is_(i, text):
            i = self.end[i] + 1 if self.t[i].kind == "open" else i + 1
        return i

    def add(self, kind: str, at: int, last: int, attrs, vis, path, tests, exempt: bool, foreign: bool, signature: str) -> None:
        if tests:
            return
        t, names = self.t[at], {p for p, _ in attrs}
        self.symbols.append({
            "crate_name": self.crate, "module_path": list(path), "name": t.text, "qualified": "::".join((self.crate, *path, t.text)), "kind": kind, "visibility": vis, "file": self.file, "line": t.line, "col": t.col,
            "line_end": self.t[min(last, len(self.t) - 1)].line, "signature": signature, "is_test": kind == "fn" and bool(names & {"test", "bench"}), "is_entry_point": kind == "fn" and t.text == "main" and not path,
            "has_no_mangle": exempt and "no_mangle" in names, "has_export_name": exempt and "export_name" in names, "impl_of_foreign_trait": foreign, "ord": len(self.symbols)})

    def signature(self, i: int, j: int) -> str:
        """The text from token ``i`` up to token ``j``, white space collapsed."""
        a, b = self.t[i], self.t[min(j, len(self.t) - 1)]
        if a.line == b.line:
            return " ".join(self.lines[a.line - 1][a.col - 1 : b.col - 1].split())
        part = [self.lines[a.line - 1][a.col - 1 :], *self.lines[a.line : b.line - 1], self.lines[b.line - 1][: b.col - 1]]
        return " ".join(" ".join(part).split())

    def function(self, begin, k, stop, attrs, vis, path, tests, foreign, in_impl, method) -> int:
        j = k + 2
        while j < stop and not self.is_(j, "{") and not self.is_(j, ";"):
            j = self.end[j] + 1 if self.t[j].kind == "open" else j + 1
        last = self.end[j] if j < stop and self.is_(j, "{") else j
        if not method:
            head = k
            while head > begin and self.t[head - 1].text in ("pub", "unsafe", "async", "const", "extern", ")"):
                head = head - 1 if self.t[head - 1].text != ")" else next(o for o, c in self.end.items() if c == head - 1)
            self.add("fn", k + 1, last, attrs, vis, path, tests, True, foreign and in_impl, self.signature(head, j))
        self.paths(k + 2, j)
        if j < stop and self.is_(j, "{"):
            if not method:
                self.body(k + 1, j, attrs, path)
            self.block(j + 1, last, path, tests, foreign, in_impl)
        return last + 1

    def plain(self, k, stop, word, attrs, vis, path, tests, foreign, in_impl) -> int:
        j = k + 2
        while j < stop and not self.is_(j, ";"):
            if self.is_(j, "{") and word not in ("const", "static", "type"):
                break
            j = self.end[j] + 1 if self.t[j].kind == "open" else j + 1
        last = self.end[j] if j < stop and self.is_(j, "{") else j
        if self.t[k + 1].text != "_" and word != "union":
            head = k if vis == "private" else next(h for h in range(k, -1, -1) if self.is_(h, "pub"))
            self.add(ITEMS[word], k + 1, last, attrs, vis, path, tests, word in ("struct", "static"), False, self.signature(head, j))
        if word == "trait":
            self.paths(k + 2, j)
            if j < stop and self.is_(j, "{"):
                self.members(j + 1, last, path, tests, foreign, in_impl)
        elif word in ("struct", "enum", "union"):
            self.fields(k + 2, last, path)
        else:
            self.block(k + 2, last, path, tests, foreign, in_impl)
        return last + 1

    def fields(self, i: int, stop: int, path: tuple) -> None:
        """Types of fields; the fields' and variants' own names are no references."""
        while i < stop:
            if self.is_(i, "#") and self.is_(i + 1, "["):
                i, _ = self.attributes(i)
            elif self.t[i].kind == "ident" and self.is_(i + 1, ":") and not self.two(i + 1, "::"):
                i += 2
            elif self.t[i].kind == "ident" and i and self.t[i - 1].text in ("{", ",", "]") and (i + 1 >= stop or self.t[i + 1].text in (",", "}", "(", "{", "=")):
                i += 1
            else:
                i = self.path_at(i)

    def impl(self, k, stop, path, tests) -> int:
        j = self.until(k, stop, "{")
        at, depth, name, i = None, 0, [], k + 1
        for i in range(k + 1, j):
            x = self.t[i].text
            depth += (x == "<") - (x == ">" and self.t[i - 1].text != "-")
            if x == "for" and not depth and not self.is_(i + 1, "<"):
                at = i
                break
        foreign = False
        if at:
            i, depth = k + 1, 0
            while i < at and (depth or self.t[i].text in ("<", "!", "?")):
                depth += (self.t[i].text == "<") - (self.t[i].text == ">")
                i += 1
            while i < at and self.t[i].kind == "ident":
                name.append(self.t[i].text)
                if not self.two(i + 1, "::"):
                    break
                i += 3
            if name:
                foreign = name[0] not in ("crate", "self", "super")
                self.ref(name, self.t[k].line)
        self.paths(k + 1, j)
        if j < stop:
            self.members(j + 1, self.end[j], path, tests, foreign, True)
            return self.end[j] + 1
        return stop

    def members(self, i, stop, path, tests, foreign, in_impl) -> None:
        while i < stop:
            i = self.item(i, stop, path, tests, foreign, in_impl, method=True)

    def use(self, i: int, stop: int, prefix: list[str], line: int) -> None:
        """A use tree: a reference for each name, rooted at the first."""
        while i < stop:
            names = list(prefix)
            if self.two(i, "::"):
                i += 2
            while i < stop and self.t[i].kind == "ident":
                self._ref(self.t[i].text, names[0] if names else None, [names[0], self.t[i].text] if names and names[0] != self.t[i].text else [self.t[i].text], False, line)
                names.append(self.t[i].text)
                i += 1
                if self.two(i, "::"):
                    i += 2
                else:
                    break
            if self.is_(i, "as"):
                i += 2
            elif self.is_(i, "{"):
                self.use(i + 1, self.end[i], names, line)
                i = self.end[i] + 1
            elif self.is_(i, "*"):
                i += 1
            i = i + 1 if self.is_(i, ",") else max(i, i + (i < stop and self.t[i].text not in (",",) and self.t[i].kind != "ident"))

    # -- code ------------------------------------------------------------------------------------

    def block(self, i: int, stop: int, path: tuple, tests: bool, foreign: bool, in_impl: bool) -> None:
        """Statements: nested items are symbols too, everything else is paths and macros."""
        fresh = True
        while i < stop:
            t = self.t[i]
            if fresh and self.starts_item(i):
                i = self.item(i, stop, path, tests, foreign, in_impl)
            elif t.kind == "open" and t.text == "{":
                i, fresh = i + 1, True
                continue
            else:
                fresh = t.text in (";", "}")
                j = self.path_at(i)
                i = j
                fresh = fresh or self.t[i - 1].text in (";", "}")

    def starts_item(self, i: int) -> bool:
        while self.is_(i, "#") and self.is_(i + 1, "["):
            i = self.end[i + 1] + 1
        if i + 1 >= len(self.t):
            return False
        x, y = self.t[i].text, self.t[i + 1]
        if x in ("fn", "struct", "enum", "trait", "mod", "static", "type", "use", "pub", "macro_rules"):
            return x == "use" or y.kind == "ident" or x in ("pub", "macro_rules")
        if x == "impl":
            return True
        return x == "const" and (y.kind == "ident" and y.text not in ("move",)) and not self.is_(i + 1, "{") or x in ("unsafe", "async", "extern") and y.text in ("fn", "impl", "trait", "extern")

    def paths(self, i: int, stop: int) -> None:
        while i < stop:
            i = self.path_at(i)

    def path_at(self, i: int) -> int:
        """The reference that begins at ``i``, if one does; where to go on."""
        t = self.t[i]
        if t.text == "#" and (self.is_(i + 1, "[") or self.is_(i + 1, "!") and self.is_(i + 2, "[")):
            return max(self.attributes(i)[0], i + 1)
        if t.kind != "ident" or t.text in STRICT:
            return i + 1
        before = self.t[i - 1] if i else None
        if before is not None and before.text == "." and not (i > 1 and self.two(i - 2, "..")):
            return i + 1  # fields and methods
        names, k = [t.text], i + 1
        while True:
            j = k
            if self.two(j, "::") and self.is_(j + 2, "<"):
                j = self.generic(j + 2)
                if self.two(j, "::") and j + 2 < len(self.t) and self.t[j + 2].kind == "ident":
                    names.append(self.t[j + 2].text)
                    k = j + 3
                    continue
                break
            if self.two(j, "::") and j + 2 < len(self.t) and self.t[j + 2].kind == "ident":
                names.append(self.t[j + 2].text)
                k = j + 3
                continue
            break
        if self.is_(k, "!") and not self.two(k, "!=") and k + 1 < len(self.t) and self.t[k + 1].kind == "open":
            self.macro(names, t.line, k + 1)
            return self.end[k + 1] + 1
        named = self.is_(k, ":") and not self.two(k, "::") and before is not None and before.text in ("{", ",", "(", "|", "mut")
        binding = len(names) == 1 and (named or before is not None and (before.text in ("let", "mut", "ref", "|", "fn") or before.text == "for" and self.is_(k, "in")))
        if self.is_(k, "=") and before is not None and before.text in ("<", ",") and not self.two(k, "=="):
            binding = True  # associated types
        if not binding:
            self.ref(names, t.line)
        return k

    def generic(self, i: int) -> int:
        depth = 0
        while i < len(self.t):
            x = self.t[i].text
            depth += (x == "<") - (x == ">" and not (i and self.t[i - 1].text == "-" and self.t[i - 1].joint))
            i += 1
            if not depth:
                break
        return i

    def macro(self, names: list[str], line: int, group: int) -> None:
        """The macro's name, and every name among its tokens and in its format strings."""
        self._ref(names[-1], names[0] if len(names) > 1 else None, names, False, line)
        for x in self.t[group + 1 : self.end[group]]:
            if x.kind == "ident" and x.text not in PRIMITIVE:
                self._ref(x.text, None, [x.text], False, x.line)
            elif x.kind == "str":
                for name in _FORMAT.findall(x.text.replace("{{", "  ")):
                    if name not in PRIMITIVE:
                        self._ref(name, None, [name], False, line)

    # -- bodies ----------------------------------------------------------------------------------

    def body(self, at: int, i: int, attrs, path: tuple) -> None:
        span = self.t[i : self.end[i] + 1]
        norm: list[str] = []
        for x in span:
            if x.kind == "ident":
                norm.append(x.text if x.text in KEPT else "I")
            elif x.kind in ("str", "num", "char"):
                norm.append("L")
            elif x.kind == "life":
                norm += ["'", "I"]
            else:
                norm.append(x.text)
        cyclo, cog, nodes = Complexity(self, i + 1, self.end[i]).result()
        names = {p for p, _ in attrs}
        name = self.t[at].text
        qualified = "::".join((self.crate, *path, name))
        self.bodies.append({"crate_name": self.crate, "qualified": qualified, "name": name, "file": self.file, "line": self.t[at].line, "col": self.t[at].col, "tokens": norm, "raw": [x.text for x in span], "cyclo": cyclo, "cog": cog,
                            "is_test": bool(names & {"test", "bench", "ignore"}) or "tests" in path, "ord": len(self.bodies)})
        for n, (parent, k, depth, label, line) in enumerate(nodes):
            self.branches.append({"qualified": qualified, "file": self.file, "node_id": n, "parent_id": parent, "ord": k, "depth": depth, "label": label, "line": line})


class Complexity:
    """Cyclomatic and cognitive complexity of a block, and its tree of branches, by one scan of its tokens."""

    def __init__(self, p: Parser, i: int, stop: int):
        self.p, self.cyclo, self.cog, self.nodes, self.count = p, 1, 0, [], {}
        self.scan(i, stop, 0, -1, 0)

    def result(self):
        return self.cyclo, self.cog, self.nodes

    def branch(self, nesting: int) -> None:
        self.cyclo += 1
        self.cog += 1 + nesting

    def node(self, parent: int, depth: int, label: str, line: int) -> int:
        self.count[parent] = self.count.get(parent, 0) + 1
        self.nodes.append((parent, self.count[parent] - 1, depth, label, line))
        return len(self.nodes) - 1

    def brace(self, i: int, stop: int) -> int:
        """The block that ends a condition begun at ``i``."""
        while i < stop and not self.p.is_(i, "{"):
            i = self.p.end[i] + 1 if self.p.t[i].kind == "open" else i + 1
        return i

    def text(self, i: int, j: int) -> str:
        return " ".join(x.text for x in self.p.t[i:j])

    def scan(self, i: int, stop: int, nesting: int, parent: int, depth: int) -> None:
        p = self.p
        while i < stop:
            t = p.t[i]
            prev = p.t[i - 1].text if i else ""
            if t.kind == "ident" and prev != ".":
                if t.text == "if":
                    i = self.if_(i, stop, nesting, parent, depth)
                    continue
                if t.text == "while":
                    let = p.is_(i + 1, "let")
                    i = self.loop(i, stop, nesting, parent, depth, "while-let" if let else "while", i + 1)
                    continue
                if t.text == "loop" and p.is_(i + 1, "{"):
                    i = self.loop(i, stop, nesting, parent, depth, "loop", i + 1)
                    continue
                if t.text == "for" and not p.is_(i + 1, "<"):
                    k = i + 1
                    while k < stop and not p.is_(k, "in") and not p.is_(k, "{"):
                        k = p.end[k] + 1 if p.t[k].kind == "open" else k + 1
                    if k < stop and p.is_(k, "in"):
                        label = f"for {self.text(i + 1, k)} in {self.text(k + 1, self.brace(k + 1, stop))}"
                        i = self.loop(i, stop, nesting, parent, depth, label, k + 1)
                        continue
                if t.text == "match" and p.t[i + 1].kind != "close":
                    i = self.match(i, stop, nesting, parent, depth)
                    continue
                if p.is_(i + 1, "!") and not p.two(i + 1, "!=") and i + 2 < stop and p.t[i + 2].kind == "open":
                    i = p.end[i + 2] + 1  # macros aren't looked into
                    continue
            if t.kind == "punct":
                if t.text == "?" and prev not in ("<", "+", ":", "{", "(", ",") and not p.is_(i + 1, "Sized"):
                    self.cyclo += 1
                elif (p.two(i, "&&") or p.two(i, "||")) and self.binary(i):
                    self.cyclo += 1
                    self.cog += 1
                    self.node(parent, depth, t.text * 2, t.line)
                    i += 2
                    continue
                elif p.two(i, "||") or p.two(i, "&&"):
                    i += 2
                    continue
            i += 1

    def binary(self, i: int) -> bool:
        """An operand ends before ``i``: it is no closure and no reference."""
        if not i:
            return False
        b = self.p.t[i - 1]
        return b.kind in ("num", "str", "char") or b.kind == "close" or b.text == "?" or b.kind == "ident" and b.text not in ("return", "break", "in", "match", "if", "while", "move", "else", "let", "mut", "ref", "as")

    def if_(self, i, stop, nesting, parent, depth) -> int:
        p = self.p
        at = self.brace(i + 1, stop)
        self.branch(nesting)
        me = self.node(parent, depth, "if-let" if p.is_(i + 1, "let") else "if", p.t[i].line)
        self.condition(i + 1, at, nesting + 1)
        if at >= stop:
            return stop
        self.scan(at + 1, p.end[at], nesting + 1, me, depth + 1)
        i = p.end[at] + 1
        if p.is_(i, "else"):
            if p.is_(i + 1, "if"):
                return self.if_(i + 1, stop, nesting + 1, parent, depth)
            if p.is_(i + 1, "{"):
                self.scan(i + 2, p.end[i + 1], nesting + 1, parent, depth)
                return p.end[i + 1] + 1
        return i

    def condition(self, i, j, nesting) -> None:
        """Conditions count, but show no branch in the tree."""
        keep = self.nodes, self.count
        self.nodes, self.count = [], {}
        self.scan(i, j, nesting, -1, 0)
        self.nodes, self.count = keep

    def loop(self, i, stop, nesting, parent, depth, label, cond) -> int:
        p = self.p
        at = self.brace(cond, stop)
        self.branch(nesting)
        me = self.node(parent, depth, label, p.t[i].line)
        self.condition(cond, at, nesting + 1)
        if at >= stop:
            return stop
        self.scan(at + 1, p.end[at], nesting + 1, me, depth + 1)
        return p.end[at] + 1

    def match(self, i, stop, nesting, parent, depth) -> int:
        p = self.p
        at = self.brace(i + 1, stop)
        if at >= stop:
            return i + 1
        me = self.node(parent, depth, "match", p.t[i].line)
        self.condition(i + 1, at, nesting + 1)
        k, close = at + 1, p.end[at]
        while k < close:
            begin = k
            while k < close and not p.two(k, "=>"):
                k = p.end[k] + 1 if p.t[k].kind == "open" else k + 1
            head = begin
            while p.is_(head, "#") and p.is_(head + 1, "["):
                head = p.end[head + 1] + 1
            guard = next((g for g in range(head, k) if p.is_(g, "if")), k)
            if self.text(head, guard) != "_":
                self.branch(nesting)
            if guard < k:
                self.condition(guard + 1, k, nesting + 1)
            k += 2
            begin = k
            if p.is_(k, "{"):
                k = p.end[k] + 1
            else:
                while k < close and not p.is_(k, ","):
                    k = p.end[k] + 1 if p.t[k].kind == "open" else k + 1
            self.scan(begin, min(k, close), nesting + 1, me, depth + 1)
            if p.is_(k, ","):
                k += 1
        return close + 1


def parse(text: str, crate: str, file: str) -> Parser | None:
    """The file's rows; None if it can't be parsed."""
    try:
        return Parser(text, crate, file)
    except (LexError, IndexError, RecursionError):
        return None


_SCHEMAS = {"symbols": SYMBOL, "refs": REF, "bodies": BODY, "branches": BRANCH}


def _rows(kind: str, schema: pa.Schema):
    def run(batches):
        for b in batches:
            out = []
            for path, crate, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                p = parse(text or "", crate, path)
                out += getattr(p, kind) if p else []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
    return run


def extract(files: DataFrame, kind: str) -> DataFrame:
    """symbols, refs, bodies or branches of files (path, crate_key, text), file by file, without a shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_SCHEMAS[kind]))
    return files.select("path", "crate_key", "text").mapInArrow(_rows(kind, schema), _SCHEMAS[kind])


KINDS = tuple(_SCHEMAS)


def extract_all(files: DataFrame) -> DataFrame:
    """``files`` (path, crate_key, mtime, text) as (path, crate_key, mtime, symbols, refs, bodies, branches): each file is
    parsed once; a file that can't be parsed has none of them.  Texts go through Python some megabytes at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = "path string, crate_key string, mtime long, " + ", ".join(f"{k} array<struct<{_SCHEMAS[k]}>>" for k in KINDS)
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches):
        for b in batches:
            out, held = [], 0
            for k in range(b.num_rows):
                path, crate, mtime, text = (b.column(i)[k].as_py() for i in range(4))
                p = parse(text or "", crate, path)
                out.append({"path": path, "crate_key": crate, "mtime": mtime} | {x: getattr(p, x) if p else [] for x in KINDS})
                held += len(text or "")
                if held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return files.select("path", "crate_key", F.col("mtime").cast("long").alias("mtime"), "text").mapInArrow(run, ddl)
