"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures.

A document's signature is ``positions`` minima of hashed word pairs, of which the lowest 16 bits stay.
The distance of two signatures is the number of positions in which they differ.  Positions fall into
chunks of ``chunk`` positions.  If two signatures differ in at most ``radius`` positions, then by the
pigeonhole principle some chunk has at most ``errors = radius // chunks`` differing positions; each
document enumerates, for every chunk, what is left after leaving out any ``errors`` of its positions,
and two documents within the radius share at least one such key.  So the join finds *every* pair within
the radius: nothing is capped.  (With 64 positions, chunks of 4 and a radius of 31: one error, 64 keys.)

Groups of copies don't cost their square: equal signatures are one node; a bucket first links its
members to its least one; only members that are still in different components are compared pairwise.
The components are those of the graph of all pairs within the radius.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from brindle.llm.common import hinted, ids_and_texts, lean, mix64, parts, slices, text_bytes, written
from brindle.llm.components import connected_components

POSITIONS, CHUNK, RADIUS = 64, 4, 31
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
PIECE = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


_POW: list = []


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits) of all rows, and the offsets of rows among them."""
    if not _POW:
        _POW.extend(_powers(PIECE + 1))
    power, inverse = _POW
    is_word = WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | cut[1:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + PIECE, side="right"))
        if j <= i:  # one word longer than a piece: hash it piece by piece
            h = np.uint64(0)
            for k in range(lo, ends[i], PIECE):
                part = data[k : min(k + PIECE, ends[i])].astype(np.uint64)
                h = mix64(np.array([h + (part * power[: len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
            out[i] = h
            i += 1
            continue
        part = data[lo : ends[j - 1]].astype(np.uint64)
        part *= power[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix64(out), np.searchsorted(starts, offsets)


def signatures(column: pa.Array, positions: int = POSITIONS) -> np.ndarray:
    """uint16[rows, positions]; rows without a word are all zero and don't count (see ``has_words``)."""
    rng = np.random.default_rng(20_011)
    flip = rng.integers(0, 1 << 32, positions, np.uint64).astype(np.uint32)
    odd = rng.integers(0, 1 << 32, positions, np.uint64).astype(np.uint32) | np.uint32(1)
    out = np.zeros((len(column), positions), np.uint16)
    data, offsets = text_bytes(pc.utf8_lower(column))
    for i, j in slices(offsets, 1 << 20):
        at = offsets[i : j + 1]
        words, rows = word_hashes(data[at[0] : at[-1]], at - at[0])
        n = np.diff(rows)
        pairs = words.copy()
        pairs[:-1] = mix64(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])
        keep = np.ones(len(words), bool)
        keep[rows[1:][n > 1] - 1] = False  # a row's last word starts no pair, unless it is the only one
        x = (pairs[keep] >> np.uint64(32)).astype(np.uint32)
        count = np.where(n > 1, n - 1, n)
        full = np.flatnonzero(count)
        begin = np.concatenate([[0], np.cumsum(count[full])])
        for p, q in slices(begin, 1 << 16):
            own = x[begin[p] : begin[q]]
            at_rows = begin[p:q] - begin[p]
            for k in range(positions):
                least = np.minimum.reduceat((own ^ flip[k]) * odd[k], at_rows)
                out[i + full[p:q], k] = (least & np.uint32(0xFFFF)).astype(np.uint16)
    return out


def has_words(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(pc.utf8_lower(column))
    total = np.concatenate([[0], np.cumsum(WORD[data])])
    return total[offsets[1:]] > total[offsets[:-1]]


@lean
def _sign(batches):
    for b in (p for batch in batches for p in parts(batch, 1)):
        ok = has_words(b.column(1))
        sig = signatures(b.column(1))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in sig[ok]], pa.binary())], ["id", "sig"])


def _bucket_keys(positions: int, chunk: int, errors: int):
    """For every chunk, the ways to leave out ``errors`` of its positions."""
    return [(c, left) for c in range(0, positions, chunk)
            for left in combinations(range(c, min(c + chunk, positions)), max(1, min(chunk, positions - c) - errors))]


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column)
    return data.reshape(len(column), -1).view(np.uint16) if len(column) else np.zeros((0, POSITIONS), np.uint16)


def _keyed(chunk: int, errors: int):
    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                m = _matrix(part.column(1)).astype(np.uint64)
                keys = _bucket_keys(m.shape[1], chunk, errors)
                out = np.empty((len(keys), len(m)), np.uint64)
                for r, (_, left) in enumerate(keys):
                    h = np.full(len(m), r + 1, np.uint64)
                    for p in left:
                        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + m[:, p])
                    out[r] = h
                ids = np.tile(part.column(0).to_numpy(zero_copy_only=False), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64).ravel()), pa.array(ids)], ["key", "node"])
    return run


def _whole_buckets(batches, most: int = 1 << 18):
    """Columns of whole buckets, some at a time, of a partition that is sorted by its first column; a bucket of more
    than ``most`` rows comes alone."""
    held: list = []

    def joined():
        out = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        return out

    n = 0
    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy() for c in b.columns])
            n += b.num_rows
        if n > most:
            whole = joined()
            last = int(np.searchsorted(whole[0], whole[0][-1]))
            held.append([c[last:] for c in whole])
            n -= last
            if last:
                yield [c[:last] for c in whole]
    if held:
        yield joined()


@lean
def _shared(batches):
    """Of a partition sorted by (key, node): (key, lead, node) of the buckets with two nodes or more.  What is kept
    between batches is a bucket's lead and whether it was given."""
    lead, open_ = None, None
    for b in batches:
        key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(key):
            continue
        new = np.concatenate([[open_ is None or key[0] != open_], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        first = np.concatenate([[lead if lead is not None else 0], node[at]])[np.cumsum(new)]
        open_, lead = key[-1], first[-1]
        other = first != node
        if other.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (key, first, node)], ["key", "lead", "node"])


@lean
def _crossing(batches):
    """Of buckets (key, node, comp), sorted by key: all pairs of nodes in different components.  A bucket's rows are
    compared block by block, so that no more than a block's pairs are held at once."""
    def pairs(found):
        p = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])

    for key, node, comp in _whole_buckets(batches):
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        found, held = [], 0
        for lo, hi in zip(new, [*new[1:], len(key)]):
            for i in range(lo, hi - 1):
                j = i + 1 + np.flatnonzero(comp[i + 1 : hi] != comp[i])
                if len(j):
                    found.append(np.stack([np.full(len(j), node[i]), node[j]]))
                    held += len(j)
                if held > 1 << 18:
                    yield pairs(found)
                    found, held = [], 0
        if found:
            yield pairs(found)


def _within(radius: int):
    def run(batches):
        for b in batches:
            near = (_matrix(b.column(2)) != _matrix(b.column(3))).sum(axis=1) <= radius
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(near)), b.column(1).filter(pa.array(near))], ["a", "b"])
    return run


def _verified(pairs: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    a = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_within(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, keep_id): every document that has an earlier near copy, and the one of its group that stays.

    keep_id is the least id of the group (connected components of the pairs within ``radius``).
    Case, punctuation and white space don't count.  Documents with a null id or without a word (null and
    empty texts too) belong to no group.  Rows that repeat an id count as one document each; the same id
    is never paired with itself.  Ties go to the least id.  An empty table gives no rows; other columns
    are ignored.  Texts of any length are read whole.
    """
    docs = ids_and_texts(docs, id_col, text_col).where(F.col("_id").isNotNull())
    signed = written(docs.mapInArrow(_sign, "id long, sig binary"), "sig")
    nodes = written(signed.groupBy("sig").agg(F.min("id").alias("node")), "node")
    # a node is an equal signature's least id; one id may stand for several if its rows differ: they are one document
    errors = radius // -(-POSITIONS // chunk)
    keys = nodes.select("node", "sig").mapInArrow(_keyed(chunk, errors), "key long, node long")
    shared = written(keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, lead long, node long"), "bucket")
    stars = shared.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    near = written(_verified(stars, nodes, radius), "near")
    comps = connected_components(near)
    # buckets whose members are not all connected yet: compare across components
    # (a bucket's lead was compared with all of its members)
    placed = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_buckets = placed.join(split, "key", "left_semi").select("key", "node", "comp")
    crossing = open_buckets.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_crossing, "a long, b long").distinct()
    more = written(_verified(crossing, nodes, radius), "near")
    if more.take(1):
        comps = connected_components(near.union(more))
    comps = written(comps, "comp")
    # equal signatures, and one id's several signatures, are linked too
    same = signed.join(nodes, "sig").select(F.col("id").alias("doc_id"), "node")
    placed = same.join(comps, "node", "left").select("doc_id", F.coalesce("comp", "node").alias("keep_id"))
    return placed.groupBy("doc_id").agg(F.min("keep_id").alias("keep_id")).where("doc_id <> keep_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns as they were.

    Documents with a null id or without words stay (null and empty texts too).  An id stands for one document; of
    rows that repeat it the copies of one text are one row, and rows with other texts stay if the id does (so no
    text is lost that has no near copy).  Which of such copies stays goes by all columns (as JSON), so it is the same
    in every run.  An empty table gives no rows; other columns stay as they are, whatever their names.  The ids that go
    are broadcast up to 32 MB; beyond that the join is shuffled.
    """
    pairs = written(near_duplicates(docs, id_col, text_col, radius), "dropped")
    gone = pairs.select(F.col("doc_id").alias("_gone"))
    kept = docs.join(hinted(gone, 16), F.col(id_col) == F.col("_gone"), "left_anti")
    repeated = written(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).count().where("count > 1").select("_again"), "again")
    if not repeated.take(1):
        return kept
    again = hinted(repeated, 16)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    mine = kept.join(again, F.col(id_col) == F.col("_again"), "left_semi").select(F.col(id_col).alias("_1"), F.xxhash64(text_col).alias("_2"), F.md5(F.to_json(row)).alias("_3"), row.alias("_4"))
    once = mine.groupBy("_1", "_2").agg(F.min_by("_4", "_3").alias("_4")).select("_4.*")
    return kept.join(again, F.col(id_col) == F.col("_again"), "left_anti").unionByName(once)
