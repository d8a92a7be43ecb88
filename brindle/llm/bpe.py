"""BPE encoding and decoding as bounded-lookahead streaming transducers.

``lookahead(ranks)`` computes, from the merge list alone, how many bytes past a token's end can still
change that token.  Encoding a stream then needs no more than a window: a token is emitted once that
many bytes after it have been seen, and what follows a token's end is encoded as if the text began
there (no merge crosses a token's end, so both sides merge independently).  ``Stream`` does so for texts that
come in pieces: pre-tokens are encoded once they are final, and one that goes on and on while it does.
Memory is constant: a piece, one window of bytes and a bounded cache.

In a batch of short texts, each of which is a single piece, every distinct chunk is encoded once and its ids are
gathered; longer texts go through a Stream.

Decoding is the reverse transducer: ids become bytes, and a state machine over UTF-8 keeps the at most
three bytes of an unfinished character between calls.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from brindle.llm.common import lean, parts, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, SHORT, LONG, PIECE = 1 << 20, 64, 256, 1 << 16


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    """Tokens and their ranks, of a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token, in order of rank: what the token's own bytes merge into when only
    earlier merges are allowed.  Tokens that no pair makes are left out."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = merge_short(token, ranks, rank)
            if len(parts) == 2:
                out.append((parts[0], parts[1]))
    return out


def lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes past a token's end that can bear on whether it is formed; a sufficient bound.

    Worked out merge by merge in order of rank.  Whether (u, v) merges somewhere depends on: what its own
    parts depend on; an earlier merge (x, w) that may take an x off the right edge of v, which reaches
    len(w) further and has a lookahead of its own; and an earlier merge (z, y) that may take y off the
    left edge of u.  Only earlier merges can intervene, so one pass over the list suffices.  A final
    token depends on later merges too: it must not be merged with its right neighbour, so the bound is
    the most over all merges that begin at a token's end, neighbour included.
    """
    right_of: dict[bytes, int] = {}  # the most a merge with this left part reaches past that part
    left_of: dict[bytes, int] = {}  # the most a merge with this right part reaches past that part's start
    need: dict[bytes, int] = {}
    right_edge: dict[bytes, tuple[bytes, ...]] = {}
    left_edge: dict[bytes, tuple[bytes, ...]] = {}
    for b in range(256):
        t = bytes([b])
        right_edge[t] = left_edge[t] = (t,)
    most = 0
    for u, v in merges(ranks):
        n = max(0, need.get(v, 0), need.get(u, 0) - len(v))
        for x in right_edge.get(v, (v,)):
            n = max(n, right_of.get(x, 0))
        for y in left_edge.get(u, (u,)):
            n = max(n, left_of.get(y, 0) - len(u) - len(v))
        t = u + v
        if n > need.get(t, -1):
            need[t] = n
        right_edge[t] = (t, *right_edge.get(v, (v,)))
        left_edge[t] = (t, *left_edge.get(u, (u,)))
        right_of[u] = max(right_of.get(u, 0), len(v) + n)
        left_of[v] = max(left_of.get(v, 0), len(v) + n)
        most = max(most, len(v) + n)
    return most


_NONE = 1 << 60


def merge_short(word: bytes, ranks: dict[bytes, int], below: int = _NONE) -> list[bytes]:
    """Merges in order of rank, leftmost first: for short words, with the ranks of all pairs in a list."""
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs:
        r = min(pairs)
        if r >= below:
            break
        i = pairs.index(r)
        del pairs[i]
        parts[i] += parts.pop(i + 1)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], _NONE)
    return parts


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same with a heap of pairs, for windows of long words."""
    n = len(word)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = nxt[i]
        if j >= n or end[j] != e or not alive[j]:
            continue
        if end[i] != j:
            continue
        alive[j] = 0
        end[i], nxt[i] = e, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        p = prev[i]
        if p >= 0 and (r := ranks.get(word[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = nxt[i]
    return out


class Pairs:
    """The merge list as a sorted table of pairs of ids, to merge many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = {(l << 32) + r: rank for t, rank in ranks.items() for i in range(1, len(t)) if (l := ranks.get(t[:i])) is not None and (r := ranks.get(t[i:])) is not None}
        self.keys = np.array(sorted(keys), np.int64)
        self.made = np.array([keys[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def merge(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the words data[at[i]:at[i + 1]]: in each round every word merges its leftmost pair of the
        least rank, and words without one are done."""
        n = len(at) - 1
        ids, word = self.bytes[data], np.repeat(np.arange(n), np.diff(at))
        rank = np.full(len(ids), _NONE)
        if len(ids) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.rank(ids[:-1], ids[1:]), _NONE)
        done = []
        while len(ids):
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            count = np.diff(np.append(begin, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, begin), count)
            still = least < _NONE
            if not still.all():
                done.append((word[~still], ids[~still]))
                ids, word, rank, least = ids[still], word[still], rank[still], least[still]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == least)
            hit = hit[np.diff(word[hit], prepend=-1) != 0]
            ids[hit] = rank[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            rank[hit] = -1  # to be looked up again, and so is the pair before it
            before = hit[(hit > 0) & (word[np.maximum(hit - 1, 0)] == word[hit])] - 1
            rank[before] = -1
            ids, word, rank = ids[keep], word[keep], rank[keep]
            new = np.flatnonzero(rank == -1)
            right = np.minimum(new + 1, len(ids) - 1)
            rank[new] = np.where((right > new) & (word[right] == word[new]), self.rank(ids[new], ids[right]), _NONE)
        word, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        return ids[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])


class Transducer:
    """Encodes a stream of bytes, without pre-tokenization: feed pieces, take ids as they become stable."""

    def __init__(self, ranks: dict[bytes, int], ahead: int):
        self.ranks, self.ahead, self.window = ranks, ahead, b""

    def feed(self, piece: bytes) -> list[int]:
        """Ids that nothing that may follow can change."""
        self.window += piece
        out: list[int] = []
        if len(self.window) > 2 * self.ahead:
            out = self._emit(len(self.window) - self.ahead)
        return out

    def _emit(self, stable: int) -> list[int]:
        out, at = [], 0
        for t in merge_long(self.window, self.ranks):
            if at + len(t) > stable:
                break
            out.append(self.ranks[t])
            at += len(t)
        self.window = self.window[at:]
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.window))


class Encoder:
    """Encodes pre-tokens (runs that ``PATTERN`` finds), each merged on its own; long ones go through a Transducer."""

    def __init__(self, ranks: dict[bytes, int], ahead: int | None = None, cache: int = CACHE):
        self.ranks, self.most = ranks, cache
        self.ahead = lookahead(ranks) if ahead is None else ahead
        self.pattern, self.pairs = regex.compile(PATTERN), Pairs(ranks)
        self.words: dict[str, bytes] = {}

    def packed(self, word: str) -> bytes:
        """A pre-token's ids as little-endian 32-bit numbers, from the cache if it is there."""
        ids = self.words.get(word)
        if ids is None:
            data = word.encode("utf-8")
            if len(data) <= SHORT:
                ids = array("i", [self.ranks[t] for t in merge_short(data, self.ranks)]).tobytes()
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[word] = ids
            else:
                t, out, step = Transducer(self.ranks, self.ahead), array("i"), max(4 * self.ahead, 4096)
                for i in range(0, len(data), step):
                    out.extend(t.feed(data[i : i + step]))
                out.extend(t.finish())
                ids = out.tobytes()
        return ids

    def encode(self, text: str) -> np.ndarray:
        """A text's ids, the text taken in pieces."""
        s = Stream(self)
        return np.frombuffer(b"".join([*(s.feed(text[i : i + PIECE]) for i in range(0, len(text), PIECE)), s.finish()]), "<i4")


#: What goes on with a pre-token that has begun: letters, numbers, white space, and all others.
_ON = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*")]


class Stream:
    """Encodes a text that comes in pieces, in memory that doesn't grow with it.

    A pre-token is final once another has begun (the last two are held back while an apostrophe may still make
    a contraction of them).  One that has grown past ``LONG`` characters goes on through a Transducer as
    it grows: only a character of another kind can end it, and of white space the last character is held back, as it
    goes with what follows.  So the state is at most a piece, ``LONG`` characters and the Transducer's window.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.pending, self.run, self.kind = encoder, "", None, 0

    def feed(self, piece: str) -> bytes:
        """Packed ids that nothing that may follow can change."""
        return b"".join(self._feed(piece))

    def _feed(self, piece: str) -> list[bytes]:
        out, text = [], self.pending + piece
        if self.run:
            end = _ON[self.kind].match(text).end()
            take = max(end - 1, 0) if self.kind == 2 else end
            out.append(self._through(text[:take]))
            text = text[take:]
            if end == take + len(text):  # it may still go on
                self.pending = text
                return out
            out.append(array("i", self.run.finish()).tobytes())
            self.run = None
        words = self.encoder.pattern.findall(text)
        last = words.pop() if words else ""
        held = words.pop() + last if words and words[-1] == "'" else last
        out += map(self.encoder.packed, words)
        if len(held) > LONG and held == last:
            self.kind = next(k for k, on in enumerate(_ON) if on.match(last[-1]).end())
            self.run = Transducer(self.encoder.ranks, self.encoder.ahead)
            held = last[-1:] if self.kind == 2 else ""
            out.append(self._through(last[: len(last) - len(held)]))
        self.pending = held
        return out

    def _through(self, text: str) -> bytes:
        return array("i", self.run.feed(text.encode("utf-8"))).tobytes()

    def finish(self) -> bytes:
        rest, self.pending = self.pending, ""
        if self.run:
            rest = self._through(rest) + array("i", self.run.finish()).tobytes()
            self.run = None
            return rest
        return b"".join(map(self.encoder.packed, self.encoder.pattern.findall(rest)))


def encode_stream(pieces: Iterable[str], encoder: Encoder) -> Iterator[int]:
    """Ids of a text that comes in pieces: each as soon as it is stable, in constant memory (``Stream``)."""
    s = Stream(encoder)
    for piece in pieces:
        yield from array("i", s.feed(piece))
    yield from array("i", s.finish())


class Decoder:
    """Ids to text, incrementally.  The state is the bytes of an unfinished character: at most three.
    An id without a token, null too, gives U+FFFD, as bytes that are no character do."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.rest = tokens, b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end are the beginning of a character."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            width = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
            return back if width > back else 0
        return 0

    def feed(self, ids: Iterable[int]) -> str:
        tokens = self.tokens
        try:
            data = self.rest + b"".join([tokens[i] for i in ids if i >= 0 or tokens[len(tokens)]])
        except (IndexError, TypeError):
            data = self.rest + b"".join([tokens[i] if i is not None and 0 <= i < len(tokens) and tokens[i] else _UNKNOWN for i in ids])
        keep = self._unfinished(data)
        self.rest = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


_UNKNOWN = "\ufffd".encode()


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        table[r] = t
    return table


_ENCODERS: dict[int, tuple[Encoder, list[bytes]]] = {}
#: A space before white space or the end, or a text that isn't taken in one piece: not to be cut at spaces.
_RUNS = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


_WORD = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"


def _chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of texts of at most ``PIECE`` characters: chunks that are encoded on their own (each with the space before it,
    but for the first ones of texts), whether they are first ones, and the texts' offsets among them.

    A space before anything but white space always begins a pre-token, so texts in which no space stands
    before white space or the end are cut at spaces; those with other runs are one chunk each.
    """
    plain = pc.invert(pc.match_substring_regex(texts, _RUNS))
    cut = pc.split_pattern(pc.if_else(plain, texts, ""), " ")
    words, at = cut.flatten(), np.asarray(cut.offsets).astype(np.int64)
    first = np.zeros(len(words), bool)
    first[at[:-1]] = True  # "" splits into one ""
    if pc.all(plain).as_py() is False:
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        words = pc.replace_with_mask(words, pa.array(np.isin(np.arange(len(words)), at[odd])), texts.take(pa.array(odd)))
    return words, first, at


def _gathered(pool: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): of rows pool[at[k]:at[k + 1]] those that ``key`` names, one after the other."""
    n = at[key + 1] - at[key]
    ends = np.concatenate([[0], np.cumsum(n)])
    return pool[np.arange(ends[-1]) + np.repeat(at[key] - ends[:-1], n)], ends


def _words(words: pa.Array, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of pre-tokens: each distinct one is merged once, all of them together."""
    coded = words.dictionary_encode()
    own = coded.dictionary
    size = pc.binary_length(own).to_numpy(zero_copy_only=False)
    short = pc.if_else(pa.array(size <= SHORT), own, "")
    ids, at = encoder.pairs.merge(*text_bytes(short))
    for k in np.flatnonzero(size > SHORT)[::-1]:
        more = np.frombuffer(encoder.packed(own[int(k)].as_py()), "<i4")
        ids = np.insert(ids, at[k], more)
        at[k + 1 :] += len(more)
    return _gathered(ids, at, coded.indices.to_numpy(zero_copy_only=False))


def encode_texts(texts: pa.Array, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts without nulls.  Texts longer than ``PIECE`` go through a Stream, piece by piece; of the
    others each distinct chunk is encoded once, and the ids are gathered."""
    long = np.flatnonzero(pc.utf8_length(texts).to_numpy(zero_copy_only=False) > PIECE)
    if len(long):
        mask = np.zeros(len(texts), bool)
        mask[long] = True
        whole, texts = texts.take(pa.array(long)), pc.if_else(pa.array(mask), "", texts)
    words, first, at = _chunks(texts)
    coded = words.dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + first
    used = np.zeros(2 * len(coded.dictionary), bool)
    used[key] = True
    which = np.flatnonzero(used)
    names = coded.dictionary.take(pa.array(which >> 1))
    names = pc.if_else(pa.array((which & 1) == 1), names, pc.binary_join_element_wise("", names, " "))
    # letters alone are a pre-token; the others are looked through, one distinct chunk at a time
    mixed = np.flatnonzero(~pc.match_substring_regex(names, _WORD).to_numpy(zero_copy_only=False))
    found = list(map(encoder.pattern.findall, names.take(pa.array(mixed)).to_pylist()))
    count = np.ones(len(names), np.int64)
    count[mixed] = [len(x) for x in found]
    begin = np.concatenate([[0], np.cumsum(count)])
    alone = np.ones(len(names), bool)
    alone[mixed] = False
    pieces = pa.concat_arrays([names.filter(pa.array(alone)), pa.array([w for x in found for w in x], pa.string())])
    order = np.empty(begin[-1], np.int64)
    order[begin[:-1][alone]] = np.arange(alone.sum())
    is_mixed = np.repeat(~alone, count)
    order[is_mixed] = alone.sum() + np.arange(int(is_mixed.sum()))
    ids, of_word = _words(pieces.take(pa.array(order)), encoder)
    place = np.zeros(len(used), np.int64)
    place[which] = np.arange(len(which))
    out, ends = _gathered(ids, of_word[begin], place[key])
    offsets = ends[at]
    if len(long):
        parts_ = [out[a:e] for a, e in zip(offsets, offsets[1:])]
        for k, t in zip(long, whole):
            parts_[k] = encoder.encode(t.as_py())
        out = np.concatenate(parts_)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts_])])
    return out, offsets


def decoded(ids: list[int], tokens: list[bytes]) -> Iterator[str]:
    """The text of ids in pieces, a bounded number of ids at a time."""
    d = Decoder(tokens)
    for i in range(0, len(ids), PIECE):
        yield d.feed(ids[i : i + PIECE])
    yield d.finish()


def _same(ids: list[int], tokens: list[bytes], text: str) -> bool:
    """Whether the ids decode to the text, compared piece by piece."""
    at = 0
    for piece in decoded(ids, tokens):
        if not text.startswith(piece, at):
            return False
        at += len(piece)
    return at == len(text)


def shared_encoder(shared) -> tuple[Encoder, list[bytes]]:
    """A worker's encoder and tokens of a broadcast vocabulary; kept, with its cache, from task to task."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        ranks, ahead = shared.value
        _ENCODERS[key] = Encoder(ranks, ahead), token_table(ranks)
    return _ENCODERS[key]


def share(spark, vocabulary: str):
    """The vocabulary and its lookahead, broadcast (about 1 MB, whatever the input)."""
    ranks = load(vocabulary)
    return spark.sparkContext.broadcast((ranks, lookahead(ranks)))


def _encode(shared):
    @lean
    def run(batches):
        encoder, tokens = shared_encoder(shared)
        for b in batches:
            for part in parts(b, 1, 4 << 20):
                texts = pc.fill_null(part.column(1), "")
                ids, offsets = encode_texts(texts, encoder)
                same = [_same(ids[a:e].tolist(), tokens, t.as_py()) for a, e, t in zip(offsets, offsets[1:], texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids", "round_trip"])
    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for each row; round_trip says that decoding gives the text back.

    The vocabulary is read by the driver and broadcast (about 1 MB, whatever the input).  Null and empty
    texts have no ids; null ids and repeated rows give a row each; very long texts are encoded and decoded in
    pieces of ``PIECE`` characters or ids; an empty table gives no rows; other columns are ignored.  No shuffle.
    """
    shared = share(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(shared), "doc_id long, n_tokens int, ids array<int>, round_trip boolean")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for each row, as ``encode`` counts them."""
    shared = share(docs.sparkSession, vocabulary)

    @lean
    def run(batches):
        encoder, _ = shared_encoder(shared)
        for b in batches:
            for part in parts(b, 1, 4 << 20):
                _, offsets = encode_texts(pc.fill_null(part.column(1), ""), encoder)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows of ids.  A null list gives a null text, an empty one an empty text; ids that are null or
    unknown give U+FFFD each.  Repeated rows give a row each; an empty table gives no rows; other columns are ignored."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_table(load(vocabulary)))

    @lean
    def run(batches):
        for b in batches:
            out = [None if not ids.is_valid else "".join(decoded(ids.as_py(), shared.value)) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
