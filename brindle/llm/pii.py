"""Personal data: a skip-chain conditional random field, decoded by loopy message passing.

Tokens are runs without white space; those that hold a digit, "@" or "=" are cut further (``pieces``): at
separators, quotes and brackets, behind "key=" and "key:", where scripts change, and around every e-mail
and IP address.  So each entity of a CSV line, a log line or minified JSON is a token of its own.  A token
is *telling* if it holds a digit of any script, "@" or "=", or a keyword with its value, follows a secret's
keyword, "=" or ":", or repeats a word that stands where a secret would; all others are plain.  Labels are O and the kinds of ``LABELS``.  Potentials: token features, a transition between
neighbours, and a skip potential between telling tokens with the same core (its letters and digits,
folded), however far apart, linking each occurrence to the next, so that a document's labels for an
entity agree.

All plain tokens have one and the same potential, so a run of g plain tokens between two telling ones is
exactly the matrix T (D T)^g, taken from a table of powers (past ``_FAR`` the normalised power no longer
changes).  Message passing over the telling tokens alone thus gives what it would over every token of
the text, and a text without telling tokens is O throughout.  One pass handles a whole batch of
documents as one graph.

Weights are fitted here by pseudo-likelihood on a generated, labelled corpus of fixed size
(``training_rows``): entities with and without context and decoration, and numbers that are no entity.
"""

from __future__ import annotations

import functools
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from brindle.llm.common import lean, parts, text_bytes

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID")
L, _FAR = len(LABELS), 64
#: Cores of at least this many letters and digits are similar if they share this many at either end.
_SIMILAR, _PART = 12, 8
_TELLING = np.zeros(256, bool)
_TELLING[[*b"0123456789@="]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\n\r\x0b\x0c"]] = True

_EMAIL = re.compile(r"(?<![A-Za-z0-9_.+\-À-ɏ])[A-Za-z0-9_.+\-À-ɏ]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_H = "[0-9A-Fa-f]{1,4}"
_IP6 = re.compile(rf"(?<![\w:.])(?=[\w:]*\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{2,7}}:|::(?:{_H}:){{0,6}}{_H})(?![\w:])")
_CORE = re.compile(r"\+?\(?[^\W_](?:.*[^\W_])?\)?", re.S)
_KEYWORD = re.compile(r"(?i)^\W*(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|apikey|key|auth|bearer|access[_-]?key)\W*[=:]?\W*$")
_ASSIGN = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|auth|bearer)\W*[=:]\W*(\S{6,})")
_ID_WORD = re.compile(r"(?i)^\W*(?:ssn|iban|passport|social|id)\W*$")
_CARD_WORD = re.compile(r"(?i)^\W*(?:card|visa|credit|mastercard|amex)\W*$")
_CALL_WORD = re.compile(r"(?i)^\W*(?:tel|phone|telephone|call|calling|mobile|cell|fax|fon|telefon|tlf|whatsapp|sms)\W*$")
#: What a hash of a file or a revision is called; such a hash is no secret.
_DIGEST_WORD = re.compile(r"(?i)^\W*(?:commit|revision|rev|md5|sha|sha-?(?:1|2|256|384|512)|hash|digest|checksum|etag|blob|tree|merge)\W*$")
#: A keyword with its value, which quotes hold together; else a run without separators or letters of other scripts.
_VALUE = r"[\w.\-]*(?i:token|secret|passw(?:or)?d|pwd|key|auth|bearer)\W{0,2}[=:](?:\"[^\"]*\"|'[^']*'|[^,;|&\"'<>\[\]{}]+)"
_RUN = r"(?:[^,;|&\"'<>\[\]{}\x85\xa0\u0370-\U0010ffff]|\d)+"
_PIECE, _PLAIN = re.compile(f"{_VALUE}|{_RUN}"), re.compile(_RUN)
#: Behind "key=" and "key:", around brackets of a call, and between numbers as long as entities.
_CUT = re.compile(r"(?<=\w=)(?=[\w+(@])|(?<=[^\W\d]:)(?=[\w+(@])|(?<=\w)(?=\()|(?<=\))(?=[^\W\d])|(?:(?<=[-.]\d{4})|(?<=\d{9}))(?=/)")
#: Where a token without a digit may be telling: it holds a keyword with its value, or follows one, "=" or ":".
_HINT = re.compile(rb"(?i:token|secret|passw(?:or)?d|pwd|key|auth|bearer)[^\w\s]{0,4}(?:[=:]\S|\s+(?=\S))|[=:][^\w\s]*\s+(?=\S)")
_DIGIT = re.compile(r"(?![0-9])\d")
_ROWS = r"(?i)token|secret|passw(?:or)?d|pwd|key|auth|bearer|\p{Nd}"
_FEATURES = (
    lambda c: bool(_EMAIL.search(c)),
    lambda c: bool(_IP.search(c)) or ":" in c and bool(_IP6.search(c)),
    lambda c: bool(re.fullmatch(r"\d{15,19}|(?:\d{4}-){3}\d{3,4}", c)),
    lambda c: bool(re.fullmatch(r"\d{15,19}|(?:\d{4}-){3}\d{3,4}", c)) and _luhn(c.replace("-", "")),
    lambda c: bool(re.fullmatch(r"\d{4}", c)),
    lambda c: bool(re.fullmatch(r"\+\d{1,3}", c)),
    lambda c: bool(re.fullmatch(r"\(\d{2,5}\)", c)),
    lambda c: bool(re.fullmatch(r"\d{3,4}[-.]\d{3,5}", c)),
    lambda c: bool(re.fullmatch(r"(?:\+\d{1,3}[-.]?)?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}|\+\d{8,14}", c)),
    lambda c: bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}", c)),
    lambda c: bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", c)),
    lambda c: bool(re.fullmatch(r"(?=.*\d)(?=.*[A-Za-z])[0-9a-fA-F]{24,}", c)),
    lambda c: bool(re.fullmatch(r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_\-/+]{16,}", c)),
    lambda c: bool(re.match(r"(?:sk|pk|ghp|AKIA|xox[bp])[-_]?[A-Za-z0-9]{10,}", c)),
    lambda c: bool(_ASSIGN.search(c)),
    lambda c: c.isdecimal() and len(c) <= 3,
    lambda c: c.isdecimal() and 5 <= len(c) <= 14,
    lambda c: bool(re.fullmatch(r"[\d.,:/%\-]+", c)) and any(x.isdecimal() for x in c),
    lambda c: not any(x.isdigit() for x in c),
)
#: Features of neighbours: a keyword one or two tokens before, "=" or ":" just before, a word in the place of a
#: secret, a part of a phone number; then those of a run of groups of digits.
_CONTEXT, _RUN_FEATURES = 9, 3
WIDTH = 1 + len(_FEATURES) + _CONTEXT + _RUN_FEATURES


def _luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def core(token: str) -> tuple[int, int]:
    """Start and end of a token without the punctuation around it; the whole of it if it is all punctuation."""
    m = _CORE.search(token)
    return m.span() if m else (0, len(token))


def pieces(token: str) -> list[tuple[int, str]]:
    """(place, text) of the tokens that a run without white space is cut into; no two entities share one."""
    out = []
    for m in _PIECE.finditer(token):
        if _ASSIGN.search(m.group()):
            out.append((m.start(), m.group()))
            continue
        for run in _PLAIN.finditer(token, *m.span()):
            p, cuts = run.group(), {0, len(run.group())}
            cuts.update(c.start() for c in _CUT.finditer(p))
            for e in [*(_EMAIL.finditer(p) if "@" in p else ()), *_IP.finditer(p), *(_IP6.finditer(p) if p.count(":") > 1 else ())]:
                cuts = {c for c in cuts if not e.start() < c < e.end()} | {e.start(), e.end()}
            at = sorted(cuts)
            out += [(run.start() + a, p[a:b]) for a, b in zip(at, at[1:]) if any(x.isalnum() or x in "@=:" for x in p[a:b])]
    return out


@functools.lru_cache(1 << 16)
def _shape(c: str) -> tuple[float, ...]:
    return (1.0, *(float(f(c)) for f in _FEATURES))


def stands_for_secret(token: str, before: str, before2: str) -> bool:
    """Whether a token without digits follows "keyword =" or "keyword:", and is long or quoted."""
    key = before if len(before.strip("\"'=:")) else before2
    a, b = core(token)
    return before.rstrip(_ENDS).endswith(("=", ":")) and bool(_KEYWORD.match(key)) and b - a >= (6 if token[0] in "\"'" else 10) and not any(x.isdigit() for x in token)


_ENDS = "\"'!#%.,"


def is_node(token: str, before: str) -> bool:
    """Telling by itself, or by the token before it."""
    return is_telling(token) or bool(_ASSIGN.search(token)) or any(x.isalnum() for x in token) and (before.rstrip(_ENDS).endswith(("=", ":")) or bool(_KEYWORD.match(before)))


def features(token: str, before: str, before2: str) -> list[float]:
    """What the model sees of a telling token and the two tokens before it."""
    a, b = core(token)
    near = (before, before2)
    return [
        *_shape(token[a:b]),
        float(any(_KEYWORD.match(x) for x in near)),
        float(any(_ID_WORD.match(x) for x in near)),
        float(any(_CARD_WORD.match(x) for x in near)),
        float(any(_CALL_WORD.match(x) for x in near)),
        float(before.rstrip("\"'").endswith(("=", ":"))),
        float(stands_for_secret(token, before, before2)),
        float(any(_DIGEST_WORD.match(x) for x in near)),
        float(token[a:b].isdecimal() and 7 <= b - a <= 15 and any(_CALL_WORD.match(x) for x in near)),
        float(bool(re.fullmatch(r"\+\d{1,3}", before)) or bool(re.fullmatch(r"\W*\(\d{2,5}\)\W*", before))),
        *[0.0] * _RUN_FEATURES,
    ]


_GROUP = re.compile(r"\W*(\+?\d{1,5})\W*")


def mark_runs(tokens: list[str], plain: list[int], before: list[str], feats: list[list[float]]) -> None:
    """Sets the features of runs of groups of digits (tokens with no plain one between them): four groups of four
    that pass Luhn's test, four that don't, and groups of 7 to 15 digits in all behind a word for a call."""
    k, groups = 0, [_GROUP.fullmatch(t) for t in tokens]
    while k < len(tokens):
        j = k + 1
        while groups[k] and j < len(tokens) and groups[j] and not plain[j]:
            j += 1
        if j - k > 1:
            digits = [g.group(1).lstrip("+") for g in groups[k:j]]
            four = len(digits) == 4 and all(len(d) == 4 for d in digits)
            luhn = four and _luhn("".join(digits))
            call = bool(_CALL_WORD.match(before[k])) and 7 <= sum(map(len, digits)) <= 15
            for f in feats[k:j]:
                f[-3:] = float(luhn), float(four and not luhn), float(call)
        k = j


def training_rows(n: int = 1500, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """``n`` generated sequences of tokens with their labels: always the same for a seed."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "th", "er", "ion", "de", "la", "que", "ung", "st", "re"]) for _ in range(r.randint(1, 4)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def card():
        d = r.choice("23456") + digits(14)
        return next(d + x for x in "0123456789" if _luhn(d + x))

    def address6():
        if r.random() < 0.5:
            return ":".join(hexes(r.randint(1, 4)) for _ in range(7)) + f":{digits(2)}"
        return f"{r.choice(['2001', 'fe80', '2a02'])}:{hexes(r.randint(1, 4))}::{hexes(r.randint(1, 4))}:{digits(2)}"

    def entity():
        k = r.randrange(14)
        if k == 0:
            return [(f"{word()}{r.choice(['.', '_', '-', ''])}{r.choice([digits(2), word()])}@{word()}{r.choice(['', digits(1)])}.{r.choice(['com', 'org', 'example.com', 'co.uk', 'net'])}", 1)]
        if k == 1:
            return [(f"{word()}@{word()}.net", 1)]
        if k == 2:
            return [(f"+{r.randint(1, 99)}", 2), (f"({digits(3)})", 2), (f"{digits(3)}-{digits(4)}", 2)]
        if k == 3:
            return [(r.choice([f"({digits(3)})", f"+{r.randint(1, 99)}"]), 2), (f"{digits(3)}-{digits(4)}", 2)]
        if k == 4:
            return [(r.choice([f"{digits(3)}{(d := r.choice('-.'))}{digits(3)}{d}{digits(4)}", f"+{r.randint(1, 99)}{digits(9)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}"]), 2)]
        if k == 5:
            return [(address6() if r.random() < 0.4 else ".".join(str(r.randint(0, 255)) for _ in range(4)), 3)]
        if k == 6:
            d = card()
            return [*([(r.choice(["card", "visa"]), 0)] if r.random() < 0.3 else []), (d if r.random() < 0.7 else "-".join(d[i : i + 4] for i in (0, 4, 8, 12)), 4)]
        if k == 7:
            d = card()
            return [*([("card", 0)] if r.random() < 0.5 else []), *((d[i : i + 4], 4) for i in (0, 4, 8, 12))]
        if k == 8:
            return [(r.choice(["token", "secret", "api_key", "password", "key"]), 0), ("=", 0), (f'"{hexes(r.choice([32, 40, 64]))}"', 5)]
        if k == 9:
            return [(f"{r.choice(['token', 'password', 'api_key'])}={r.choice([hexes(20), hexes(40), word() + digits(4) + word()])}", 5)] if r.random() < 0.6 else [(r.choice(["sk-", "ghp_", "AKIA"]) + hexes(24), 5)]
        if k == 10:
            return [*([("ssn", 0)] if r.random() < 0.5 else []), (f"{digits(3)}-{digits(2)}-{digits(4)}", 6)] if r.random() < 0.6 else [("iban", 0), (f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{digits(20)}", 6)]
        if k == 11:
            key, secret = r.choice(["token", "secret", "password", "api_key"]), "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(10, 24)))
            return [(f"{key}:", 0), (secret, 5)] if r.random() < 0.5 else [(key, 0), (r.choice("=:"), 0), (f'"{secret}"' if r.random() < 0.5 else secret, 5)]
        call = r.choice(["call", "phone", "tel", "mobile", "fax", "phone:", "Tel."])
        if k == 12:
            return [(call, 0), (digits(r.randint(7, 11)), 2)]
        return [(call, 0), *((digits(n), 2) for n in r.choice([(3, 4, 4), (4, 6), (2, 2, 2, 2, 2), (3, 3, 4), (5, 5)]))]

    year = lambda: str(r.randint(1500, 2100))

    def other():
        k = r.randrange(22)
        if k < 3:
            return [(r.choice(["note:", "see:", "key", "token", "secret", "=", "call", "phone", "card"]), 0), (word(), 0)]
        if k == 3:  # years and other numbers of four digits
            return [(year(), 0), *([(r.choice(["to", "and", "bis"]), 0)] if r.random() < 0.5 else []), (year(), 0)]
        if k == 4:
            return [(digits(4), 0) for _ in range(r.choice([1, 2, 3, 3, 5, 6]))]
        if k == 5:  # four groups, or sixteen digits, that fail Luhn's test
            d = next(x for x in iter(lambda: digits(16), None) if not _luhn(x))
            return [(d[i : i + 4], 0) for i in (0, 4, 8, 12)] if r.random() < 0.4 else [(d, 0)]
        if k == 6:
            return [(r.choice(["commit", "md5", "sha1", "sha256:", "hash", "digest:", "checksum", "revision"]), 0), *([("of", 0)] if r.random() < 0.2 else []), (hexes(r.choice([32, 40, 64])), 0)]
        if k == 7:
            return [(r.choice([f"{word()}{digits(1)}", f"md{digits(1)}", f"{digits(1)}{word()}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)}::{digits(1)}", f"{word()}::{word()}", f"{digits(2)}:{digits(2)}:{digits(2)}"]), 0)]
        if k == 8:
            return [(digits(r.randint(9, 14)), 0)]
        if k == 9:
            return [(digits(r.randint(1, 3)), 0) for _ in range(r.randint(2, 5))]
        options = [digits(1), digits(2), digits(3), year(), f"{digits(1)}.{digits(1)}", f"{digits(1)}.", f"{digits(2)}:{digits(2)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}", digits(r.randint(5, 8)), f"{digits(2)}%", f"{word()}{digits(1)}", r.choice(["=", "x=1", "a=b", "@", "@" + word()])]
        return [(options[k - 10], 0)]

    rows = []
    for _ in range(n):
        items, mark = [], r.choice(["", "", "", *(r.choice("!?*~;#)%") * k for k in (1, 2, 3))])
        kept = [entity() if r.random() < 0.55 else other() for _ in range(r.randint(1, 3))]
        for _ in range(r.randint(2, 7)):
            items += [(word(), 0) for _ in range(r.randint(1, 6))]
            if r.random() < 0.8:
                items += r.choice(kept)
        items += [(word(), 0)]
        end = lambda t: t + r.choice(["", "", "", ".", ","]) + (mark if r.random() < 0.9 else "")
        up = r.random() < 0.15
        rows.append(([end(t.upper() if up else t) for t, _ in items], [y for _, y in items]))
    return rows


def is_telling(token: str) -> bool:
    return any(x in "0123456789@=" or x > "\x7f" and x.isdecimal() for x in token)


def skips(keys: list[str]) -> list[tuple[int, int]]:
    """Links between each occurrence of a core and its next one, and between similar cores: those that share their first
    or last eight letters and digits."""
    last, out = {}, []
    for i, k in enumerate(keys):
        for part in (k, "^" + k[:_PART], "$" + k[-_PART:]) if len(k) >= _SIMILAR else (k,):
            at = last.get(part)
            if at is not None and (part == k or keys[at] != k) and (at, i) not in out[-2:]:
                out.append((at, i))
            last[part] = i
    return out


def skip_key(token: str) -> str:
    """What makes tokens similar: letters and digits alone, folded.  One or two characters link nothing."""
    m = _ASSIGN.search(token)
    token = m.group(1) if m else token
    a, b = core(token)
    k = "".join(x for x in token[a:b].casefold() if x.isalnum())
    return k if len(k) > 4 else ""


_WEIGHTS: list = []


def model() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The weights in use: fitted once in the driver, broadcast to the workers (``install``)."""
    if not _WEIGHTS:
        install(fit())
    return _WEIGHTS[0]


def install(weights: tuple) -> None:
    if not _WEIGHTS:
        _WEIGHTS.append(weights)


@functools.lru_cache(1)
def fit() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights of features, of plain tokens, of transitions and of skips: all log potentials."""
    x, y, prev, nxt, pairs = [], [], [], [], []
    for tokens, labels in training_rows():
        cut = [(p, k if is_telling(p) or not is_telling(t) else 0) for t, k in zip(tokens, labels) for p in ([p for _, p in pieces(t)] if is_telling(t) else [t])]
        tokens, labels = zip(*cut)
        base, where, lead = len(y), {}, []
        for i, t in enumerate(tokens):
            if is_node(t, tokens[i - 1] if i else ""):
                where[i] = len(y)
                x.append(features(t, tokens[i - 1] if i else "", tokens[i - 2] if i > 1 else ""))
                lead.append(tokens[i - 1] if i else "")
            else:
                x.append([0.0] * WIDTH)
            y.append(labels[i])
            prev.append(labels[i - 1] if i else -1)
            nxt.append(labels[i + 1] if i + 1 < len(tokens) else -1)
        told = [i for i in where]
        mark_runs([tokens[i] for i in told], [i - j - 1 for i, j in zip(told, [-1, *told])], lead, rows := [x[where[i]] for i in told])
        assert all(a is x[where[i]] for a, i in zip(rows, told))
        keys = [skip_key(tokens[i]) or f"#{i}" for i in told]
        pairs += [(where[told[a]], where[told[b]]) for a, b in skips(keys)]
        assert base < len(y)
    x, y, prev, nxt = np.array(x), np.array(y), np.array(prev), np.array(nxt)
    plain = (x[:, 0] == 0).astype(float)
    one = np.eye(L)
    p, q = np.where(prev[:, None] >= 0, one[prev], 0), np.where(nxt[:, None] >= 0, one[nxt], 0)
    near = np.zeros((len(y), L))
    for a, b in pairs:
        near[a] += one[y[b]]
        near[b] += one[y[a]]
    w, flat, t, s = np.zeros((WIDTH, L)), np.zeros(L), np.zeros((L, L)), np.zeros((L, L))
    target, rate, moments = one[y], 0.1, [np.zeros_like(v) for v in (w, flat, t, s)]
    for _ in range(250):
        z = x @ w + plain[:, None] * flat + p @ t + q @ t.T + near @ s
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        g = e / e.sum(axis=1, keepdims=True) - target
        grads = (x.T @ g / len(y) + 1e-5 * w, plain @ g / len(y) + 1e-5 * flat, (p.T @ g + g.T @ q) / len(y) + 1e-4 * t, (near.T @ g + g.T @ near) / 2 / len(y) + 1e-4 * s)
        for v, d, m in zip((w, flat, t, s), grads, moments):
            m *= 0.97
            m += 0.03 * d * d
            v -= rate * d / (np.sqrt(m) + 1e-6)
        rate *= 0.99
    return w, flat, t, (s + s.T) / 2


@functools.lru_cache(1)
def _runs() -> np.ndarray:
    """[g, L, L]: what g plain tokens between two telling ones amount to, each scaled to a largest entry of 1."""
    _, flat, t, _ = model()
    step, out = np.exp(t - t.max()), []
    d = np.exp(flat - flat.max())[:, None] * step
    m = step
    for _ in range(_FAR + 1):
        out.append(m / m.max())
        m = m @ d
        m = m / m.max()
    return np.stack(out)


def marginals(unary: np.ndarray, before: np.ndarray, after: np.ndarray, chain: np.ndarray, gap: np.ndarray, skip: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Loopy sum-product over telling tokens.

    unary: [n, L] log potentials; before, after: plain tokens up to the document's start or end (-1: a
    telling token lies between); chain: [m, 2] neighbouring telling tokens, gap: plain tokens between
    them; skip: [k, 2].  Only messages whose inputs changed are sent again, until none changes (or for
    ``rounds``): exact if there is no loop, however long a chain is.  In documents with loops a message has settled once
    it moves by 1e-3 at most; from round 8 on it goes only a part of the way, and that part shrinks with the rounds,
    so messages that would swing for ever settle too.
    """
    _, flat, _, s = model()
    runs = _runs()
    ends = np.exp(flat - flat.max())
    pot = np.exp(unary - unary.max(axis=1, keepdims=True))
    has = before > 0
    pot[has] *= np.einsum("l,nlm->nm", ends, runs[np.minimum(before[has] - 1, _FAR)])
    has = after > 0
    pot[has] *= np.einsum("nlm,m->nl", runs[np.minimum(after[has] - 1, _FAR)], ends)
    pot /= pot.max(axis=1, keepdims=True)
    psi = np.concatenate([runs[np.minimum(gap, _FAR)], np.broadcast_to(np.exp(s - s.max()), (len(skip), L, L))])
    src, dst = np.concatenate([chain, skip]).reshape(-1, 2).T
    m = len(src)
    if not m:
        return pot / pot.sum(axis=1, keepdims=True)
    src, dst, psi = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([psi, psi.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    order = np.argsort(dst, kind="stable")
    ends_at = np.flatnonzero(np.diff(dst[order], prepend=-1))
    into = dst[order][ends_at]
    msg, logpot = np.zeros((2 * m, L)), np.log(pot + 1e-300)
    by = np.argsort(src, kind="stable")
    nth = np.arange(2 * m) - np.searchsorted(src[by], src[by])
    leaving = np.full((len(pot), nth.max() + 1), -1)
    leaving[src[by], nth] = by
    doc = np.maximum(np.cumsum(before >= 0) - 1, 0)
    loops = np.isin(doc, doc[skip.reshape(-1, 2)[:, 0]])
    total, active = logpot.copy(), np.arange(2 * m)
    for k in range(rounds) if rounds else itertools.count():
        old = msg[active]
        out = total[src[active]] - msg[back[active]]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("el,elm->em", out, psi[active]) + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        if k >= 8:  # damped once it should have settled
            new = np.where(loops[src[active]][:, None], old + min(0.5, 8 / k) * (new - old), new)
        moved = np.abs(np.exp(new) - np.exp(old)).max(axis=1) > np.where(loops[src[active]], 1e-7 if k < 8 else 1e-3, 1e-7)
        np.add.at(total, dst[active], new - old)
        msg[active] = new
        if not moved.any():
            break
        then = leaving[np.unique(dst[active[moved]])].ravel()
        active = np.unique(np.concatenate([then[then >= 0], active[moved]]))
    total = logpot.copy()
    total[into] += np.add.reduceat(msg[order], ends_at, axis=0)
    b = np.exp(total - total.max(axis=1, keepdims=True))
    return b / b.sum(axis=1, keepdims=True)


_TOKEN = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def _gaps(text: str, again: frozenset = frozenset()) -> tuple[list[str], list[tuple[int, int]], list[list[float]], list[int], int]:
    """Telling tokens, their spans, features, the plain tokens before each, and those after the last."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    bytes_at = [np.flatnonzero(_TELLING[raw])]
    bytes_at.append(np.array([m.end() if space[m.end() - 1] else m.end() - 1 for m in _HINT.finditer(data)], np.int64))
    ends = np.append(starts[1:], len(raw))
    one_byte = len(data) == len(text)
    if not one_byte:
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        bytes_at.append(np.searchsorted(chars, np.array([m.start() for m in _DIGIT.finditer(text)], np.int64), side="right") - 1)
    for word in again:
        bytes_at.append(np.array([m.start() for m in re.finditer(re.escape(word.encode()), data)], np.int64))
    hit = np.unique(np.searchsorted(starts, np.concatenate(bytes_at), side="right") - 1)
    token = lambda k: data[starts[k] : ends[k]].rstrip(b" \t\n\r\x0b\x0c").decode() if k >= 0 else ""
    tokens, spans, feats, plain, lead, last, run, near, words = [], [], [], [], [], -1, 0, ("", ""), set()
    for k in hit:
        a = int(starts[k] if one_byte else chars[starts[k]])
        run += int(k - last - 1)
        if k - last > 1:
            near = (token(k - 1), token(k - 2) if k - last > 2 else near[0])
        last = k
        for at, t in pieces(token(k)):
            a1, a2 = core(t)
            if is_node(t, near[0]) or t[a1:a2] in again:
                if not again and stands_for_secret(t, *near):
                    words.add(t[a1:a2])
                tokens.append(t)
                spans.append((a + at, a + at + len(t)))
                feats.append(features(t, *near))
                plain.append(run)
                lead.append(near[0])
                run = 0
            else:
                run += 1
            near = (t, near[0])
    if words:  # those that stand for a secret are nodes wherever else they are
        return _gaps(text, frozenset(words))
    mark_runs(tokens, plain, lead, feats)
    return tokens, spans, feats, plain, run + int(len(starts) - last - 1)


#: What occurrences of a core share within a document: "keyword=value" and the context before it.
_SHARED = [15, *range(1 + len(_FEATURES), WIDTH - 1 - _RUN_FEATURES)]


def _pooled(feats: list[list[float]], keys: list[str]) -> list[list[float]]:
    """The features, with the evidence of any occurrence of a core given to all of them."""
    seen: dict = {}
    for k, f in zip(keys, feats):
        seen[k] = [max(x, f[c]) for x, c in zip(seen[k], _SHARED)] if k in seen else [f[c] for c in _SHARED]
    out = [list(f) for f in feats]
    for k, f in zip(keys, out):
        for c, x in zip(_SHARED, seen[k]):
            f[c] = x
    return out


def label(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the entities of each text, in one message-passing run over all of them."""
    w, _, _, _ = model()
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    feats, owner, tokens, spans, before, after, chain, gap, skip = [], [], [], [], [], [], [], [], []
    for d, text in enumerate(texts):
        own, at, f, plain, rest = _gaps(text)
        if not own:
            continue
        base = len(tokens)
        tokens += own
        spans += at
        keys = [skip_key(t) or f"#{k}" for k, t in enumerate(own)]
        feats += _pooled(f, keys)
        owner += [d] * len(own)
        before += [plain[0], *[-1] * (len(own) - 1)]
        after += [*[-1] * (len(own) - 1), rest]
        chain += [(base + k, base + k + 1) for k in range(len(own) - 1)]
        gap += plain[1:]
        skip += [(base + a, base + b) for a, b in skips(keys)]
    if not tokens:
        return found
    p = marginals(np.array(feats) @ w, np.array(before), np.array(after), np.array(chain, np.int64).reshape(-1, 2), np.array(gap, np.int64), np.array(skip, np.int64).reshape(-1, 2))
    for k, y in enumerate(p.argmax(axis=1)):
        if y:
            t, (a, _) = tokens[k], spans[k]
            m = _ASSIGN.search(t) if y == 5 else None
            own = [x.span() for x in _EMAIL.finditer(t)] if y == 1 else [x.span() for x in (*_IP.finditer(t), *_IP6.finditer(t))] if y == 3 else []
            for s, e in own or [m.span(1) if m else core(t)]:
                while m and e > s and not t[e - 1].isalnum():
                    e -= 1
                found[owner[k]].append((a + s, a + e, LABELS[y]))
    return found


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of one kind of entity replaced by its kind in brackets."""
    out, at, last = [], 0, None
    for a, b, kind in spans:
        between = text[at:a]
        if not (last == kind == "PHONE" and not between.strip(" ")) and not (last == kind == "CARD" and not between.strip(" ")):
            out += [between, f"[{kind}]"]
        at, last = b, kind
    return "".join([*out, text[at:]])


def clean(column: pa.Array) -> tuple[pa.Array, list[list[tuple[int, int, str]]], np.ndarray]:
    """Redacted texts (nulls stay null), and for the rows given by the last array their entities."""
    filled = pc.fill_null(column.cast(pa.string()), "")
    data, offsets = text_bytes(filled)
    told = np.concatenate([[0], np.cumsum(_TELLING[data])])[offsets]
    rows = np.flatnonzero((told[1:] > told[:-1]) | pc.match_substring_regex(filled, _ROWS).to_numpy(zero_copy_only=False))
    texts = filled.take(pa.array(rows)).to_pylist()
    spans = label(texts)
    changed = np.array([k for k, s in enumerate(spans) if s], np.int64)
    if len(changed):
        new = pa.array([redact(texts[k], spans[k]) for k in changed], pa.string())
        mask = np.zeros(len(column), bool)
        mask[rows[changed]] = True
        column = pc.replace_with_mask(column.cast(pa.string()), pa.array(mask), new)
    return column, [spans[k] for k in changed], rows[changed]


def _find(shared):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    @lean
    def run(batches):
        install(shared.value)
        for b in (p for batch in batches for p in parts(batch, 1)):
            text, spans, rows = clean(b.column(1))
            found = [[] for _ in range(b.num_rows)]
            for k, s in zip(rows, spans):
                found[k] = [{"start": a, "end": e, "kind": x} for a, e, x in s]
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(found, kind)], ["doc_id", "text", "entities"])

    return run


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, entities) for each row: the text with entities replaced by their kind, and where
    they were (character offsets into the original text, end excluded).

    Null texts stay null and have no entities; empty texts stay empty; null ids and repeated rows give a
    row each.  Ties between labels go to the first of ``LABELS``.  An empty table gives no rows; other
    columns are ignored.  No shuffle: each batch is decided where it lies.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit())
    return rows.mapInArrow(_find(shared), "doc_id long, text string, entities array<struct<start:int,end:int,kind:string>>")


def redact_private(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with redacted texts, and ``n_chars`` (if there is such a column) set to the lengths of those that changed.

    Null texts stay null, empty ones empty; null ids and repeated rows give a row each; an empty table gives no rows;
    other columns stay as they are, whatever their names.  No shuffle."""
    names = docs.columns
    t, n = names.index(text_col), names.index(size_col) if size_col in names else None
    shared = docs.sparkSession.sparkContext.broadcast(fit())

    @lean
    def run(batches):
        install(shared.value)
        for b in (p for batch in batches for p in parts(batch, t)):
            text, _, rows = clean(b.column(t))
            cols = [text if k == t else b.column(k) for k in range(b.num_columns)]
            if n is not None and len(rows):
                mask = np.zeros(b.num_rows, bool)
                mask[rows] = True
                cols[n] = pc.if_else(pa.array(mask), pc.utf8_length(text).cast(cols[n].type), cols[n])
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
