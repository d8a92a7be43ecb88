"""Harmonic packing: lengths fall into reciprocal-capacity classes, workers fill bins on their own.

Class j holds pieces longer than capacity/(j+1) and at most capacity/j tokens, for j = 1 .. classes - 1;
the last class, numbered ``classes``, holds everything shorter.  A bin of class j takes exactly j pieces,
so it fits whatever its members are and no running sum is needed: a piece's place is its rank within
(worker, class).  Workers (ids modulo their number) share nothing, and each leaves at most one open bin
per class.  There is a worker for every ``ROWS`` documents, so what one of them ranks doesn't grow with the table.

Tokens are those of operator 5, and an end mark for each document.  Documents longer than the capacity are cut:
whole-capacity pieces first, the rest as a piece of its own; ``start`` is a piece's first token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.llm import bpe

CAPACITY, CLASSES, WORKERS, ROWS = 2048, 32, 64, 1 << 20


def word_count(text: str | Column) -> Column:
    """White-space-separated words; empty and null texts have none."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("[^ \\t\\n\\r]+"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, classes: int = CLASSES, workers: int | None = None, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(worker, class, bin, slot, doc_id, piece, start, tokens): one row per piece of a document.

    Texts are tokenized once, where they lie; only ids and token counts are shuffled, by (worker, class).
    Rows with empty or null texts, or a null id, have no piece.  Rows that repeat an id are pieces of their
    own; ties go by (doc_id, piece, tokens).  An empty table gives no rows; other columns are ignored.  Bins
    hold at most ``capacity`` tokens.  ``workers``: ``WORKERS``, or one for every ``ROWS`` rows if those are more.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    return pack_sizes(bpe.token_counts(own, id_col, text_col, vocabulary).withColumnRenamed("n_tokens", "n"), workers or worker_count(docs), capacity, classes)


def pack_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, classes: int = CLASSES, workers: int | None = None) -> DataFrame:
    """The same with words as tokens."""
    sizes = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), word_count(text_col).alias("n"))
    return pack_sizes(sizes, workers or worker_count(docs), capacity, classes)


def worker_count(docs: DataFrame) -> int:
    return max(WORKERS, -(-docs.count() // ROWS))


def pack_sizes(sizes: DataFrame, workers: int, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """``pack`` of (doc_id, n): documents of n tokens without the end mark."""
    rows = sizes.where("n > 0").select("doc_id", (F.col("n") + 1).cast("long").alias("n"))
    whole = F.expr(f"transform(sequence(0, cast((n - 1) div {capacity} as int)), i -> struct(i as piece, least(n - i * {capacity}L, {capacity}L) as tokens))")
    pieces = rows.select("doc_id", F.explode(whole).alias("p")).select("doc_id", F.col("p.piece").alias("piece"), F.col("p.tokens").alias("tokens"))
    kind = F.least(F.expr(f"{capacity} div tokens"), F.lit(classes)).cast("int")
    pieces = pieces.withColumn("worker", F.pmod("doc_id", F.lit(workers)).cast("int")).withColumn("class", kind)
    place = F.row_number().over(Window.partitionBy("worker", "class").orderBy("doc_id", "piece", "tokens")) - 1
    return pieces.withColumn("_p", place).select(
        "worker", "class", F.expr("cast(_p div class as long)").alias("bin"), F.expr("cast(_p % class as int)").alias("slot"), "doc_id", "piece", F.expr(f"piece * {capacity}L").alias("start"), "tokens")


PACK_SQL = f"""
WITH rows_ AS (
  SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
workers AS (SELECT CAST(greatest({WORKERS}, -(-count(*) // {ROWS})) AS BIGINT) AS w FROM documents),
sized AS (SELECT doc_id, words + 1 AS n FROM rows_ WHERE words > 0),
pieces AS (
  SELECT doc_id, CAST(i AS INTEGER) AS piece, CAST(i * {CAPACITY} AS BIGINT) AS start, CAST(least(n - i * {CAPACITY}, {CAPACITY}) AS BIGINT) AS tokens
  FROM sized, LATERAL (SELECT unnest(range(0, (n - 1) // {CAPACITY} + 1)) AS i) t),
placed AS (
  SELECT *, CAST(((doc_id % w) + w) % w AS INTEGER) AS worker, CAST(least({CAPACITY} // tokens, {CLASSES}) AS INTEGER) AS class FROM pieces, workers),
ranked AS (SELECT *, row_number() OVER (PARTITION BY worker, class ORDER BY doc_id, piece, tokens) - 1 AS p FROM placed)
SELECT worker, class, CAST(p // class AS BIGINT) AS bin, CAST(p % class AS INTEGER) AS slot, doc_id, piece, start, tokens FROM ranked
"""
