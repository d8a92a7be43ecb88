"""HTML extraction by union-free wrappers, inferred per host.

A page becomes a stream of tags and text marks ("#", or "~" inside head, nav, header, footer, aside and
the like).  ``shape`` turns repeats of a stream into groups: equal blocks that follow one another become
one ("+" block), and blocks that differ only in their inner groups do too, with those groups optional.
A block may be of any length.  So pages of one template have few distinct expressions, unless their rows differ
in more than that.  ``align`` then merges the expressions of a host, one after the other: a single
instance of what the other one repeats becomes a group, what both have is matched by a heaviest common
subsequence, what only one has becomes optional, and groups are merged inside.  The result is a regular
expression without unions: tags, text slots, optional parts ("?") and repeats ("+").

Only distinct expressions are shuffled, and merged in a tree of small tasks, so a host with a third of
all pages is no single task.  A slot that has the same texts (repeats don't count) on all of a host's pages
that have it, two at least, is part of the template and isn't extracted.
"""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from brindle.llm.common import hinted, lean, parts, written
from brindle.llm.urltree import host_of

FAN, GRID = 64, 1 << 22
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?[A-Za-z][A-Za-z0-9:-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[^<>]*>|[^<]+|<", re.S | re.I)
ASIDE = frozenset("head nav header footer aside form button select menu".split())


def tokens(page: str) -> tuple[list[str], list[str]]:
    """Tags (lower-case names, "/" before those of end tags), "#" and "~" for texts, and the texts."""
    out, texts, inside = [], [], []
    for m in _TOKEN.finditer(page):
        tag = m.group(2)
        if tag:
            tag = tag.lower()
            out.append(tag)
            if tag in ASIDE:
                inside.append(tag)
            elif tag[0] == "/" and tag[1:] in ASIDE and tag[1:] in inside:
                del inside[len(inside) - 1 - inside[::-1].index(tag[1:]) :]
        elif m.group()[0] != "<" or len(m.group()) == 1:
            text = " ".join(entities.unescape(m.group()).split())
            if text:
                mark = "~" if inside else "#"
                if out and out[-1] == mark:
                    texts[-1] += " " + text
                else:
                    out.append(mark)
                    texts.append(text)
    return out, texts


# An item is a tag, a mark, or a tuple that begins with "+" or "?" and goes on with items.


def _is_mark(x) -> bool:
    return x == "#" or x == "~"


def _repeat(items: tuple) -> tuple:
    return items[0] if len(items) == 1 and isinstance(items[0], tuple) and items[0][0] == "+" else ("+", *items)


def slots(items) -> int:
    """The text slots of a sequence of items."""
    return sum(slots(x[1:]) if isinstance(x, tuple) else _is_mark(x) for x in items)


def _runs(x: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(period, begin, end) of the maximal stretches of ``x`` that repeat with a period of ``least`` or more, two
    periods long at least; shortest periods first, then from the left.

    Every such stretch of period p holds two neighbouring multiples of p with equal items, so only those
    pairs (n ln n of them) are extended both ways, by the ranks of stretches of 2, 4, 8 ... items.
    Nothing is hashed and no period is left out.
    """
    n = len(x)
    if n < 2 * least:
        return []
    period = np.arange(least, n // 2 + 1)
    count = (n - 1) // period
    p = np.repeat(period, count)
    i = (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * p
    some = x[i] == x[i + p]
    i, p = i[some], p[some]
    if not len(i):
        return []
    ranks = [x]
    while len(ranks[-1]) > 1 << (len(ranks) - 1):
        r, w = ranks[-1], 1 << (len(ranks) - 1)
        ranks.append(np.unique(r[:-w].astype(np.int64) * (int(r.max()) + 1) + r[w:], return_inverse=True)[1])
    on, off = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    j = i + p
    for k in reversed(range(len(ranks))):
        r, w = ranks[k], 1 << k
        at = np.flatnonzero(j + on < len(r))
        on[at[r[i[at] + on[at]] == r[j[at] + on[at]]]] += w
        at = np.flatnonzero(i - off - w >= 0)
        off[at[r[i[at] - off[at] - w] == r[j[at] - off[at] - w]]] += w
    long = on + off >= p
    return sorted(set(zip(p[long].tolist(), (i - off)[long].tolist(), (j + on)[long].tolist())))


def _levels(stream) -> list[int]:
    """1 for a start tag that is closed, -1 for the end tag that closes it, and 0 for everything else: an end tag
    closes the last open start tag of its name, and leaves those after it unclosed."""
    out, open_, held = [0] * len(stream), [], {}
    for i, x in enumerate(stream):
        if _is_mark(x):
            continue
        if x[0] != "/":
            open_.append(i)
            held[x] = held.get(x, 0) + 1
        elif held.get(x[1:]):
            while True:
                k = open_.pop()
                held[stream[k]] -= 1
                if stream[k] == x[1:]:
                    break
            out[k], out[i] = 1, -1
    return out


def _blocks(names: list, levels: list[int], least: int, fits=None) -> list[tuple[int, int, int]]:
    """(begin, period, copies) of repeats to be joined, apart from each other: the shortest periods first.  A block
    begins where the fewest elements are open, and holds elements whole."""
    ids: dict = {}
    depth = [0]
    for x in levels:
        depth.append(depth[-1] + x)
    taken, out = bytearray(len(names)), []
    for p, s, e in _runs(np.array([ids.setdefault(x, len(ids)) for x in names]), least):
        o = min(range(s, s + p), key=depth.__getitem__)
        copies = 0
        while o + (copies + 1) * p <= e and depth[o + (copies + 1) * p] == depth[o] == min(depth[o + copies * p : o + (copies + 1) * p]):
            copies += 1
        end = o + copies * p
        if copies > 1 and not any(taken[o:end]) and (fits is None or fits(o, end)):
            taken[o:end] = b"\1" * (end - o)
            out.append((o, p, copies))
    return sorted(out)


_SHAPES: dict = {}
_HELD = [0]


def shape(stream: tuple) -> tuple[tuple, str, list[int], int]:
    """The stream with its repeats as groups, that as text, the slot of each of its texts, and the number of slots.
    Pages of one template have few distinct streams, so they are kept (as many as a few MB hold)."""
    known = _SHAPES.get(stream)
    if known is None:
        marks = iter(range(len(stream)))
        seq = [(x, [[next(marks)]] if _is_mark(x) else [], level) for x, level in zip(stream, _levels(stream))]
        while True:
            before = len(seq)
            seq = _strict(seq)
            if len(seq) == before:
                seq = _loose(seq)
                if len(seq) == before:
                    break
        own = [s for _, slot, _ in seq for s in slot]
        slot = [0] * sum(map(len, own))
        for k, places in enumerate(own):
            for t in places:
                slot[t] = k
        expr = tuple(x for x, *_ in seq)
        if _HELD[0] > 1 << 20:
            _SHAPES.clear()
            _HELD[0] = 0
        _HELD[0] += len(stream)
        known = _SHAPES[stream] = expr, dump(expr), slot, len(own)
    return known


def fold(stream: list[str], texts: list) -> tuple[tuple, list[list]]:
    """The stream with its repeats as groups, and the texts of each slot, slots in order."""
    expr, _, slot, n = shape(tuple(stream))
    own: list[list] = [[] for _ in range(n)]
    for k, t in zip(slot, texts):
        own[k].append(t)
    return expr, own


def _strict(seq: list) -> list:
    """Joins equal blocks that follow one another."""
    names, out, at = [x for x, *_ in seq], [], 0
    for o, p, copies in _blocks(names, [level for *_, level in seq], 1):
        out += seq[at:o]
        at = o + p * copies
        own = [sum(same, []) for same in zip(*([s for _, slot, _ in seq[k : k + p] for s in slot] for k in range(o, at, p)))]
        out.append((_repeat(tuple(names[o : o + p])), own, 0))
    return out + seq[at:]


def _core(x):
    return x[1] if isinstance(x, tuple) and x[0] == "?" else x


def _units(seq: list) -> list:
    """Plain items, each with the groups that follow it."""
    out = [(None, [], [], 0)]
    for x, own, level in seq:
        if isinstance(x, tuple):
            out[-1][2].append((x, own, 0))
        else:
            out.append((x, own, [], level))
    return out


def _loose(seq: list) -> list:
    """Joins blocks that are equal but for the groups in them."""
    first, *units = _units(seq)
    out, at = list(first[2]), 0
    flat = lambda some: [y for u in some for y in ((u[0], u[1], u[3]), *u[2])]
    for o, p, copies in _blocks([u[0] for u in units], [u[3] for u in units], 2, lambda a, b: any(u[2] for u in units[a:b])):
        out += flat(units[at:o])
        at = o + p * copies
        block, own = [], []
        for j in range(p):
            column = units[o + j : at : p]
            block.append(column[0][0])
            own += [sum(x, []) for x in zip(*(u[1] for u in column))]
            kinds: dict = {}
            for k, u in enumerate(column):
                for x, slot, _ in u[2]:
                    kinds.setdefault(_core(x), []).append((k, x, slot))
            for x, seen in kinds.items():
                each = len(seen) == copies == len({k for k, y, _ in seen if y == x})
                block.append(x if each else ("?", x))
                own += [sum(s, []) for s in zip(*(slot for *_, slot in seen))]
        out.append((_repeat(tuple(block)), own, 0))
    return out + flat(units[at:])


# A wrapper is a list of items, of which ("?", x) may be absent.


def _lead(x):
    while isinstance(x, tuple):
        x = x[1]
    return x


def _match(a, b):
    """(the item that stands for both, the weight of what they have in common), or None."""
    if a == b:
        return a, _weight(a)
    may = isinstance(a, tuple) and a[0] == "?" or isinstance(b, tuple) and b[0] == "?"
    x, y = _core(a), _core(b)
    weight = _weight(x)
    if x != y:
        if not (isinstance(x, tuple) and isinstance(y, tuple)) or _lead(x) != _lead(y):
            return None
        pairs = _pairs(x[1:], y[1:])
        x, weight = ("+", *_joined(x[1:], y[1:], pairs)), 1 + sum(p[3] for p in pairs)
    return ("?", x) if may else x, weight


def _weight(x) -> int:
    x = _core(x)
    return 1 + sum(map(_weight, x[1:])) if isinstance(x, tuple) else 2


def _optional(x):
    return x if isinstance(x, tuple) and x[0] == "?" else ("?", x)


def _pairs(a, b) -> list[tuple[int, int, object, int]]:
    """Matched places of two sequences in order, with what stands for both and its weight: equal ends first,
    then the heaviest common subsequence.  An instance of a wrapper is placed in it whole, as nothing
    weighs more."""
    head, out = 0, []
    while head < min(len(a), len(b)) and a[head] == b[head]:
        out.append((head, head, a[head], _weight(a[head])))
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    if n and m:
        out += [(head + i, head + j, x, w) for i, j, x, w in _common(a[head : head + n], b[head : head + m])]
    return out + [(len(a) - k, len(b) - k, a[-k], _weight(a[-k])) for k in range(tail, 0, -1)]


def _common(a, b) -> list[tuple[int, int, object, int]]:
    """The heaviest common subsequence.  Where its table would have more than ``GRID`` cells it is halved as
    Hirschberg does, in memory linear in the sequences, until the tables are small enough."""
    known: dict = {}
    if len(a) * len(b) <= GRID:
        return _table(a, b, known)
    ids: dict = {}
    at = np.array([ids.setdefault(y, len(ids)) for y in b])
    like: dict = {}
    for y, k in ids.items():
        like.setdefault(_lead(y), []).append((y, k))
    weights: dict = {}

    def gain(x):
        """The weights of an item of a with each of b's, 0 where they don't match."""
        if x not in weights:
            own = []
            for y, k in like.get(_lead(x), ()):
                if (x, y) not in known:
                    known[x, y] = _match(x, y)
                if known[x, y]:
                    own.append((k, known[x, y][1]))
            weights[x] = own
        w = np.zeros(len(ids), np.int64)
        for k, v in weights[x]:
            w[k] = v
        return w

    def best(items, places):
        """[j]: the weight of the items, in the given order, with the first j of the places."""
        row = np.zeros(len(places) + 1, np.int64)
        for x in items:
            w = gain(x)[places]
            row[1:] = np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0))
            np.maximum.accumulate(row, out=row)
        return row

    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        if k - i < 2 or (k - i) * (m - j) <= GRID:
            out += [(i + p, j + q, x, w) for p, q, x, w in _table(a[i:k], b[j:m], known)]
            continue
        half = (i + k) // 2
        cut = j + int(np.argmax(best(a[i:half], at[j:m]) + best(a[half:k][::-1], at[j:m][::-1])[::-1]))
        todo += [(half, k, cut, m), (i, half, j, cut)]
    return out


def _table(a, b, known: dict) -> list[tuple[int, int, object, int]]:
    n, m, out = len(a), len(b), []
    best = [[0] * (m + 1) for _ in range(n + 1)]
    got: dict = {}
    for i in range(n - 1, -1, -1):
        row, under = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            key = a[i], b[j]
            if key not in known:
                known[key] = _match(*key)
            hit = known[key]
            row[j] = max(under[j], row[j + 1])
            if hit and under[j + 1] + hit[1] > row[j]:
                row[j] = under[j + 1] + hit[1]
                got[i, j] = hit
    i = j = 0
    while i < n and j < m:
        if (i, j) in got:
            out.append((i, j, *got[i, j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _joined(a, b, pairs) -> tuple:
    out, i, j = [], 0, 0
    for p, q, x, _ in [*pairs, (len(a), len(b), None, 0)]:
        out += [_optional(y) for y in (*a[i:p], *b[j:q])]
        if x is not None:
            out.append(x)
        i, j = p + 1, q + 1
    return tuple(out)


def _bodies(items, out: dict | None = None) -> tuple[dict, int]:
    """{nesting: {first plain item: bodies, longest first}} of the groups in items that are whole elements (a body is given
    by its plain items), and how deep groups are nested in them."""
    out, deep = {} if out is None else out, 0
    for x in items:
        if isinstance(x, tuple):
            g = _core(x)
            inner = _bodies(g[1:], out)[1] if isinstance(g, tuple) else -1
            deep = max(deep, inner + 1)
            body = tuple(y for y in g[1:] if not isinstance(y, tuple)) if isinstance(g, tuple) else ()
            if body and body[-1] == "/" + body[0]:
                own = out.setdefault(inner, {}).setdefault(body[0], [])
                if body not in own:
                    own.append(body)
                    own.sort(key=lambda y: (-len(y), y))
    return out, deep


def _grouped(items, bodies: dict, whole: bool = False) -> tuple:
    """The items with each single instance of one of the bodies as a group, inner ones first.  ``whole``: the items are a
    group's own body, which is none."""
    items = tuple((x[0], *_grouped(x[1:], bodies, x[0] == "+")) if isinstance(x, tuple) else x for x in items)
    for level in sorted(bodies):
        out, i = [], 0
        while i < len(items):
            for body in bodies[level].get(items[i], ()) if not isinstance(items[i], tuple) else ():
                j = i
                for want in body:
                    while j > i and j < len(items) and isinstance(items[j], tuple):
                        j += 1
                    if j == len(items) or items[j] != want:
                        break
                    j += 1
                else:
                    if not (whole and i == 0 and j == len(items)):
                        out.append(("+", *items[i:j]))
                        i = j
                        break
            else:
                out.append(items[i])
                i += 1
        items = tuple(out)
    return items


def align(a, b) -> tuple:
    """The least general sequence that has both as instances, by one alignment.  What is repeated in one is taken
    for a repeat in the other, if it occurs there but once."""
    a, b = _grouped(a, _bodies(b)[0]), _grouped(b, _bodies(a)[0])
    return _joined(a, b, _pairs(a, b))


def infer(expressions) -> tuple:
    """The wrapper of expressions, merged in the given order."""
    out = None
    for e in expressions:
        out = e if out is None else align(out, e)
    return out or ()


def slot_map(expression, wrapper) -> list[int]:
    """For each slot of the expression, the wrapper's slot; -1 if it has no place there."""
    plain, grouped = _placed(expression, wrapper), _grouped(expression, _bodies(wrapper)[0])
    if grouped == expression:
        return plain
    other = _placed(grouped, wrapper)
    return min(other, plain, key=lambda m: m.count(-1))


def _placed(expression, wrapper) -> list[int]:
    begin = [0]
    for x in wrapper:
        begin.append(begin[-1] + slots([x]))
    placed = {i: j for i, j, _, _ in _pairs(expression, wrapper)}
    out: list[int] = []
    for i, x in enumerate(expression):
        n = slots([x])
        if i not in placed:
            out += [-1] * n
        elif n:
            j = placed[i]
            if isinstance(x, tuple) and _core(x) != _core(wrapper[j]):
                out += [begin[j] + k if k >= 0 else -1 for k in _placed(_core(x)[1:], _core(wrapper[j])[1:])]
            else:
                out += range(begin[j], begin[j + 1])
    return out


def render(items) -> str:
    """A wrapper as text: <tag>, # and ~ for slots, (...)+ and (...)?."""
    out = []
    for x in items:
        if isinstance(x, tuple):
            body = render(x[1:])
            out.append(body + "?" if x[0] == "?" and isinstance(x[1], str) else f"({body}){x[0]}" if x[0] == "+" or x[1][0] != "+" else body[:-1] + "*")
        else:
            out.append(x if _is_mark(x) else f"<{x}>")
    return "".join(out)


def dump(items) -> str:
    return json.dumps(items, separators=(",", ":"))


def load(text: str) -> tuple:
    deep = lambda x: tuple(map(deep, x)) if isinstance(x, list) else x
    return deep(json.loads(text))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _pages(batch: pa.RecordBatch, column: int):
    """(part, row, expression as text, slot of each text, number of slots, texts, marks) of each page."""
    for part in parts(batch, column):
        for i, page in enumerate(pc.fill_null(part.column(column), "").to_pylist()):
            stream, texts = tokens(page)
            _, expr, slot, n = shape(tuple(stream))
            yield part, i, expr, slot, n, texts, stream


@lean
def _shapes(batches):
    """Of (host, html): the distinct (host, expression) of a partition, with the pages, and the least and
    greatest digest of a page's texts for each slot."""
    found: dict = {}

    def rows():
        cols = list(zip(*((h, e, n, lo, hi) for (h, e), (n, lo, hi) in found.items()))) or [[]] * 5
        found.clear()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["host", "expr", "n", "lo", "hi"])

    for b in batches:
        for part, i, expr, slot, n, texts, _ in _pages(b, 1):
            key = part.column(0)[i].as_py(), expr
            own: list[dict] = [{} for _ in range(n)]
            for k, t in zip(slot, texts):
                own[k][t] = None
            lo = hi = [_digest("\0".join(x)) for x in own]
            if key in found:
                n, a, z = found[key]
                found[key] = n + 1, list(map(min, a, lo)), list(map(max, z, hi))
            else:
                found[key] = 1, lo, hi
            if len(found) >= 4096:
                yield rows()
    yield rows()


def _infer(key, table):
    """Of the expressions of a host (and salt): one wrapper."""
    rows = sorted(zip(table["n"].to_pylist(), table["expr"].to_pylist()), key=lambda r: (-r[0], r[1]))
    out = infer(load(e) for _, e in rows)
    return pa.table({"host": [key[0].as_py()], "expr": [dump(out)], "n": [sum(n for n, _ in rows)]})


def _place(batches):
    """Of (host, expr, wrapper): the expression's slot map."""
    for b in batches:
        maps = [slot_map(load(e), load(w)) for e, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.list_(pa.int32()))], ["host", "expr", "slots"])


@lean
def _texts(batches):
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("aside", pa.bool_()), ("text", pa.string())]))
    for b in batches:
        for part, rows in itertools.groupby(_pages(b, 2), key=lambda r: r[0]):
            keys, texts = [], []
            for _, _, expr, slot, _, own, stream in rows:
                keys.append(expr)
                texts.append([{"slot": s, "aside": x == "~", "text": t} for s, x, t in zip(slot, filter(_is_mark, stream), own)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.string()), pa.array(texts, kind)], ["page_id", "host", "expr", "found"])


def _wrappers(shapes: DataFrame) -> DataFrame:
    """(host, wrapper).  A host's expressions are merged about ``FAN`` at a time, those results again, and so on, until
    one is left: no task merges more, whatever a host holds."""
    some = shapes.select("host", "expr", "n")
    while True:
        hosts = written(some.groupBy("host").count(), "hosts")
        most = hosts.agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return some.select("host", F.col("expr").alias("wrapper"))
        own = hosts.select("host", F.ceil(F.col("count") / FAN).cast("long").alias("salts")).where("salts > 1")
        salted = some.join(hinted(own, 128), "host", "left").withColumn("salt", F.pmod(F.xxhash64("expr"), F.coalesce("salts", F.lit(1))))
        some = written(salted.select("host", "salt", "expr", "n").groupBy("host", "salt").applyInArrow(_infer, "host string, expr string, n long"), "merged")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, text, fields, wrapper_slots) for each row: fields is an array of (slot, text) of the
    texts in the wrapper's slots in page order, and text joins those outside head, nav, header, footer
    and the like by line ends.

    Null and empty html has no field and the text "".  Null URLs and those without a host are taken as
    one host, "".  Null ids and repeated rows give a row each.  A host with one page has no fixed slot.
    A text whose expression found no place in its host's wrapper has slot -1.  An empty
    table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    seen = rows.select("host", "html").mapInArrow(_shapes, "host string, expr string, n long, lo array<long>, hi array<long>")
    each = lambda f, c: F.expr(f"aggregate(collect_list({c}), cast(null as array<long>), (a, x) -> if(a is null, x, zip_with(a, x, (p, q) -> {f}(p, q))))")
    shapes = written(seen.groupBy("host", "expr").agg(F.sum("n").alias("n"), each("least", "lo").alias("lo"), each("greatest", "hi").alias("hi")), "shapes")
    wrappers = written(_wrappers(shapes), "wrappers")
    maps = shapes.join(hinted(wrappers, 4096), "host").select("host", "expr", "wrapper").mapInArrow(_place, "host string, expr string, slots array<int>")
    maps = written(maps, "slot-maps")
    # a slot is fixed if its least and greatest digest agree over all expressions of the host
    ends = shapes.join(maps, ["host", "expr"]).select("host", "n", F.explode(F.arrays_zip("slots", "lo", "hi")).alias("s")).select("host", "n", "s.*")
    fixed = ends.where("slots >= 0").groupBy("host", "slots").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo = hi and n > 1")
    fixed = fixed.groupBy("host").agg(F.sort_array(F.collect_set("slots")).alias("fixed"))
    plan = maps.join(fixed, "host", "left").select(F.col("host").alias("_h"), F.col("expr").alias("_e"), "slots", F.coalesce("fixed", F.array().cast("array<int>")).alias("fixed"))
    plan = written(plan, "plans")
    found = rows.select("page_id", "host", "html").mapInArrow(_texts, "page_id long, host string, expr string, found array<struct<slot: int, aside: boolean, text: string>>")
    both = found.join(hinted(plan, 2048), (F.col("host") == F.col("_h")) & (F.col("expr") == F.col("_e")))
    placed = F.transform("found", lambda x: F.struct(F.get(F.col("slots"), x["slot"]).alias("slot"), x["aside"].alias("aside"), x["text"].alias("text")))
    both = both.withColumn("found", F.filter(placed, lambda x: ~F.array_contains("fixed", x["slot"])))
    text = F.array_join(F.transform(F.filter("found", lambda x: ~x["aside"]), lambda x: x["text"]), "\n")
    fields = F.transform("found", lambda x: F.struct(x["slot"].alias("slot"), x["text"].alias("text")))
    return both.select("page_id", "host", text.alias("text"), fields.alias("fields"), F.size(F.array_distinct(F.transform("found", lambda x: x["slot"]))).alias("wrapper_slots"))
