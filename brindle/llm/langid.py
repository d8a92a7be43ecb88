"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points, lower-cased; everything that is no letter becomes one space.  n-grams of 1 to
``ORDERS`` code points hash into 2**BITS buckets.  The log-probability matrix (buckets x languages,
float32, about 1 MB for four languages) is broadcast; a batch is scored as a sparse matrix in row form,
bucket numbers with row offsets, times that matrix.

The classifier is fitted on at most ``sample`` labelled rows (those with the least hash, a bound that
doesn't grow with the input); everything else reads every document, whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from brindle.llm.common import lean, parts, slices, text_bytes

ORDERS, BITS, SAMPLE = (1, 2, 3), 16, 4000
#: A document goes if another language than the declared one is more probable by this log-odds in all,
#: and by this much a letter; so a few odd words don't decide.
ODDS, ODDS_A_LETTER = 50.0, 1.0
_FOLD = np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else 32 for c in range(0x3000)], np.uint32)


@dataclass(frozen=True)
class Model:
    """Languages in order, and log P(bucket | language) + the languages' log priors."""

    langs: tuple[str, ...]
    logp: np.ndarray
    prior: np.ndarray


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of whole rows and the rows' offsets among them; runs of spaces are one."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    fold = np.where(cp < len(_FOLD), _FOLD[np.minimum(cp, len(_FOLD) - 1)], cp)
    keep = np.ones(len(fold), bool)
    space = fold == 32
    keep[1:] = ~(space[1:] & space[:-1])
    keep[at[:-1][at[:-1] < len(keep)]] = True
    return fold[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def buckets(column: pa.Array):
    """Yields (first row, last row, an array of bucket numbers for each order, offsets of the rows among
    them, letters by row).  Each array has one number a code point; where no whole n-gram is left in the
    row it is 2**BITS, which stands for nothing."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, 1 << 18):
        fold, at = _code_points(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = len(fold)
        letters = np.concatenate([[0], np.cumsum(fold != 32)])[at]
        parts, h = [], np.zeros(n, np.uint32)
        last = np.zeros(n, bool)  # less than ``order`` code points are left here
        for order in range(1, max(ORDERS) + 1):
            if order > 1:
                ends = at[1:] - order + 1
                last[ends[ends >= at[:-1]]] = True
            h = h * np.uint32(0x01000193)
            h[: max(n - order + 1, 0)] += fold[order - 1 :]
            if order in ORDERS:
                x = h * np.uint32(0x9E3779B1) + np.uint32(order * 0x7FEB352D & 0xFFFFFFFF)
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x2C1B3C6D)
                x >>= np.uint32(32 - BITS)
                x[last] = 1 << BITS
                parts.append(x.astype(np.intp))
        yield i, j, parts, at, np.diff(letters)


def scores(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """log P(text, language) by row and language, and the letters by row."""
    out, letters = np.tile(model.prior.astype(np.float64), (len(column), 1)), np.zeros(len(column), np.int64)
    by_lang = [np.append(model.logp[:, k], np.float32(0)) for k in range(len(model.langs))]
    for i, j, parts, at, n in buckets(column):
        letters[i:j] = n
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            continue
        for k, logp in enumerate(by_lang):
            each = logp.take(parts[0])
            for x in parts[1:]:
                each += logp.take(x)
            out[i + full, k] += np.add.reduceat(each, at[full], dtype=np.float64)
    return out, letters


def _counts(langs: tuple[str, ...]):
    def run(batches):
        total = np.zeros(((1 << BITS) + 1, len(langs)))
        for b in batches:
            lang = np.array([langs.index(x) for x in b.column(1).to_pylist()])
            for i, j, parts, at, _ in buckets(b.column(0)):
                own = np.repeat(lang[i:j], np.diff(at))
                for k in np.unique(lang[i:j]):
                    for x in parts:
                        total[:, k] += np.bincount(x[own == k], minlength=(1 << BITS) + 1)
        for k in range(len(langs)):
            at = np.flatnonzero(total[:-1, k])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), k)), pa.array(total[at, k])], ["bucket", "lang", "n"])
    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, smoothing: float = 0.5) -> Model:
    """Counts n-grams of at most ``sample`` labelled rows: those with the least hash of id, language and text, equal rows
    taken as one.  Only hashes and languages are ranked; the texts of the sample alone go through Python.  No labelled
    row gives a model of one language, "und"; ties can't occur among different rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where("_id is not null and _lang is not null")
    named = rows.withColumn("_hash", F.xxhash64("_id", "_lang", "_text"))
    # tasks send the driver what is below a bar that lets about twice the sample through, not a sample each; where
    # equal rows leave too little below it, the bar is raised
    n, share = rows.count(), 2
    while True:
        below = named if share * sample >= n else named.where(F.col("_hash") < F.lit(int(share * sample / n * 2**64) - 2**63))
        picked = below.select("_hash", "_lang").distinct().orderBy("_hash").limit(sample).collect()
        if len(picked) == sample or share * sample >= n:
            break
        share *= 16
    langs = tuple(sorted({r["_lang"] for r in picked}))
    if not langs:
        return Model(("und",), np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    most = picked[-1]["_hash"]
    own = below.where(F.col("_hash") <= F.lit(most)).dropDuplicates(["_hash"]).select("_text", "_lang")
    got = own.mapInArrow(_counts(langs), "bucket long, lang long, n double").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toPandas()
    count = np.full((1 << BITS, len(langs)), smoothing)
    count[got["bucket"].to_numpy(np.int64), got["lang"].to_numpy(np.int64)] += got["n"].to_numpy()
    share = np.array([sum(r["_lang"] == x for r in picked) for x in langs]) / len(picked)
    return Model(langs, np.log(count / count.sum(axis=0)).astype(np.float32), np.log(share))


def _identify(shared):
    def run(batches):
        model = shared.value
        index = {x: k for k, x in enumerate(model.langs)}
        for b in (p for batch in batches for p in parts(batch, 1)):
            s, letters = scores(b.column(1), model)
            best = s.argmax(axis=1)
            at = np.array([index.get(x, -1) for x in b.column(2).to_pylist()], np.int64)
            top = s[np.arange(len(s)), best]
            rest = s.copy()
            rest[np.arange(len(s)), best] = -np.inf
            second = rest.max(axis=1) if s.shape[1] > 1 else top
            odds = np.where(at >= 0, top - s[np.arange(len(s)), np.maximum(at, 0)], 0.0)
            gone = (letters == 0) | ((at >= 0) & (odds > ODDS) & (odds > ODDS_A_LETTER * letters))
            found = [model.langs[k] if n else "und" for k, n in zip(best, letters)]
            margin = np.where(letters > 0, (top - second) / np.maximum(letters, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array(margin), pa.array(~gone)], ["doc_id", "found", "margin", "kept"])
    return run


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, found, margin, kept) for each row: the language, its log-odds a letter over the second
    one, and whether the document stays.

    It goes if it has no letter (found is "und"; null and empty texts too), or if it is declared to be in
    one of the model's languages and another one is far more probable (``ODDS`` in all and
    ``ODDS_A_LETTER`` a letter).  An unknown or null declared language never makes a document go.  Null
    ids and repeated rows give a row each; ties go to the first language by name.  Empty tables give no
    rows; other columns are ignored.
    """
    model = model or fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    return rows.mapInArrow(_identify(shared), "doc_id long, found string, margin double, kept boolean")


def keep_identified(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``identify`` keeps, with all their columns, decided where they lie: no shuffle.

    Null and empty texts go, and so do those without a letter; null ids and null or unknown languages don't make
    a row go; repeated rows stay or go alike; an empty table gives no rows; other columns stay as they are, whatever
    their names."""
    model = model or fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    i, t, g = (names.index(c) for c in (id_col, text_col, lang_col))
    decide = _identify(shared)

    @lean
    def run(batches):
        for b in (p for batch in batches for p in parts(batch, t)):
            text = pc.fill_null(b.column(t).cast(pa.string()), "")
            own = pa.RecordBatch.from_arrays([b.column(i), text, b.column(g).cast(pa.string())], ["_id", "_text", "_lang"])
            kept = pa.concat_arrays([out.column(3) for out in decide([own])])
            yield b.filter(kept)

    return docs.mapInArrow(run, docs.schema)
