"""A training corpus from ``documents``: reject, deduplicate, cut repeats, pack.

Every stage works on all that its predecessor kept.  The stages before the last return the
columns of ``documents`` and leave other columns out; the last returns the packed pieces.  In all
stages an empty table gives no rows, rows may repeat, ids and other columns may be null, and a
null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscribe.llm import common, minhash, packing, quality, substring, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects.

    Each row is judged by its text alone, so equal texts share a fate; empty texts get the base
    score and stay.  Without toxic labels nothing is rejected.
    """
    model = toxicity.fit(docs, common.load(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject.

    Each row is judged by its text alone; texts under 20 words, null and empty ones too, go.
    """
    return quality.keep_good(docs).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by sets of five-word shingles with a similarity
    of 0.8 or more: that of the smallest id.

    Rows with a null id take no part and stay.  Rows of one id are judged each by its own text,
    so a text stays if no smaller row is like it, and of identical rows one stays.  Texts without
    words are like nothing, but of identical rows one stays.
    """
    return minhash.keep_first(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages (13 words or more) that documents of smaller ids hold.

    Untouched texts stay as they are, of others the kept words are joined by single spaces and
    ``n_chars`` is counted anew; a document of which nothing is left goes, one without words stays.
    Rows with a null id stay whole; rows of one id do not cut each other.
    """
    kept = substring.deduplicate(docs, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = kept.filter("n_words > n_removed or n_words = 0").withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of bounded length; an empty text is its end id alone."""
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack_best_fit),
]

#: The classifier and the tokenizer cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return docs
