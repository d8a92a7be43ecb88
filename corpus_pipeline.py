"""The corpus pipeline: language ID, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in
the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from brindle.llm import langid, minhash, packing, pii
from brindle.llm.common import written


def language_id(spark, docs, sf_dir):
    """Documents whose language is the declared one, or can't be told from it, stay (operator 9)."""
    return langid.keep_identified(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays (operator 7)."""
    return minhash.drop_near_duplicates(docs)


def private_data(spark, docs, sf_dir):
    """Texts without personal data; n_chars follows (operator 8)."""
    return pii.redact_private(docs)


def pack(spark, docs, sf_dir):
    """Bins of pieces of documents (operator 4)."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", private_data), ("packing", pack)]

#: The classifier, the signatures and the random field can't be written in SQL; tests/llm compares the
#: pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
