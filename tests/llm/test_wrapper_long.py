"""Wrappers of long, irregular pages."""

import random

import pytest

from brindle.llm import wrapper


@pytest.mark.parametrize("grid", [1, 50, 1 << 22])
def test_alignments_are_heaviest_whatever_the_table(monkeypatch, grid):
    r = random.Random(5)
    items = ["a", "/a", "b", "#", "~", ("+", "a", "#"), ("?", "b"), ("+", "a", "b"), ("?", ("+", "a", "#"))]
    for _ in range(60):
        a, b = (tuple(r.choice(items) for _ in range(r.randint(1, 30))) for _ in "ab")
        monkeypatch.setattr(wrapper, "GRID", 1 << 30)
        want = sum(w for *_, w in wrapper._pairs(a, b))
        monkeypatch.setattr(wrapper, "GRID", grid)
        got = wrapper._pairs(a, b)
        assert sum(w for *_, w in got) == want
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_long_pages_keep_their_slots():
    r = random.Random(1)
    pages = [[r.choice("abcdefghijkl") if k % 3 else "#" for k in range(2600)] for _ in range(2)]
    a, b = (tuple(p) for p in pages)
    w = wrapper.align(a, b)
    for x in (a, b):
        placed = wrapper.slot_map(x, w)
        assert len(placed) == wrapper.slots(x) and -1 not in placed and placed == sorted(set(placed))


def _brute_runs(x, least):
    """All maximal stretches that repeat with a period, by trying every place and period."""
    out, n = set(), len(x)
    for p in range(least, n // 2 + 1):
        same = [x[i] == x[i + p] for i in range(n - p)]
        i = 0
        while i < n - p:
            j = i
            while j < n - p and same[j]:
                j += 1
            if j - i >= p:
                out.add((p, i, j + p))
            i = j + 1
    return sorted(out)


def test_repeats_of_any_period_are_found():
    import numpy as np

    r = random.Random(4)
    for _ in range(200):
        block = [r.randrange(3) for _ in range(r.randint(1, 40))]
        x = [r.randrange(3) for _ in range(r.randint(0, 30))] + block * r.randint(1, 4) + [r.randrange(3) for _ in range(r.randint(0, 30))]
        for least in (1, 2):
            assert wrapper._runs(np.array(x), least) == _brute_runs(x, least)


@pytest.mark.parametrize("cells", [1, 5, 11, 60])
def test_long_records_are_one_group(cells):
    """Records of up to 60 differently tagged cells (301 tokens), 1, 3 and 5 times, share the slots of one group."""
    page = lambda rows: "<table>" + "".join("<tr>" + "".join(f"<td><x{c}>v{i}</x{c}></td>" for c in range(cells)) + "</tr>" for i in range(rows)) + "</table>"
    folded = [wrapper.fold(*wrapper.tokens(page(n))) for n in (1, 3, 5)]
    w = wrapper.infer(e for e, _ in folded)
    assert wrapper.slots(w) == cells
    for (e, texts), n in zip(folded, (1, 3, 5)):
        assert wrapper.slot_map(e, w) == list(range(cells)) and all(t == [f"v{i}" for i in range(n)] for t in texts)


def test_long_streams_fold_in_time():
    import time

    r = random.Random(1)
    stream = [r.choice("abcdefghijkl") if k % 3 else "#" for k in range(16_000)]
    began = time.time()
    expr, texts = wrapper.fold(stream, list(range(stream.count("#"))))
    assert time.time() - began < 5 and sorted(sum(texts, [])) == list(range(stream.count("#")))


def _pattern(items):
    """A wrapper as a regular expression over tokens, each between angle brackets."""
    import re

    return "".join(f"(?:{_pattern(x[1:])}){x[0]}" if isinstance(x, tuple) else f"<{re.escape(x)}>" for x in items)


def test_wrappers_accept_their_pages_as_regular_expressions():
    import re

    r = random.Random(6)

    def page():
        rows = "".join(f"<tr><td>{r.randrange(99)}</td><td>{'<b>x</b>' if r.random() < 0.4 else ''}y</td></tr>" for _ in range(r.randint(1, 6)))
        return f"<html><body>{'<h1>t</h1>' if r.random() < 0.5 else ''}<table>{rows}</table>{'<p>more</p>' * r.randint(0, 4)}</body></html>"

    streams = [wrapper.tokens(page()) for _ in range(40)]
    w = wrapper.infer(sorted({wrapper.shape(tuple(s))[0] for s, _ in streams}, key=str))
    for s, _ in streams:
        assert re.fullmatch(_pattern(w), "".join(f"<{x}>" for x in s))


def test_fields_of_generated_pages(spark):
    """Pages made of a known template: every field comes out, in a slot of its own, and nothing of the template."""
    r = random.Random(9)
    rows, want = [], {}
    for k in range(300):
        lines = [(f"name{k}x{i}", f"price{r.randrange(999)}") for i in range(r.randint(1, 90))]
        title, note = f"title {k}", f"note {k}" if k % 3 == 0 else None
        body = "".join(f"<div class=r><span>{a}</span><b>cost</b><i>{b}</i></div>" for a, b in lines)
        rows.append((k, f"http://{'hot' if k % 4 else 'cold'}.org/{k}", f"<html><head><title>shop</title></head><body><nav><a>home</a><a>help</a></nav><h1>{title}</h1><div id=m>{body}</div>{f'<p>{note}</p>' if note else ''}<footer>about us</footer></body></html>"))
        want[k] = [title, *(x for line in lines for x in line), *([note] if note else [])]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    slot = {}
    for g in got:
        assert [f["text"] for f in g["fields"]] == want[g["page_id"]] and g["text"] == "\n".join(want[g["page_id"]])
        for f in g["fields"]:
            slot.setdefault((g["host"], f["text"].rstrip("0123456789x ").rstrip("0123456789")), set()).add(f["slot"])
    assert all(len(s) == 1 and -1 not in s for s in slot.values()) and len(slot) == 8
