"""From raw documents to packed training bins, one stage after the other.

All stages take empty tables (and give none), texts of any length, repeated rows and null values
in any column. Null and empty texts pass the filters; the mix, which counts words, takes none.
Columns besides doc_id, text, source and n_chars are carried along by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import jaccard, mixing, packing, repeats, toxicity
from riskloom.llm.tables import ship
from riskloom.session import configure, materialize

#: Shingle words and least similarity in per cent of near duplicates; bytes of repeated passages.
SHINGLE, SIMILARITY, PASSAGE = 5, 80, 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Rows without doc_id are judged, too, and never train; without labels of both classes
    every score is the share of toxic labels. Repeated rows are judged alike.
    """
    ship(configure(spark))
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group of near duplicates.

    Empty texts and rows without doc_id stay. Rows that share a doc_id are judged each by its own
    text; of equal ones one stays.
    """
    ship(configure(spark))
    return jaccard.keep_first(docs, SHINGLE, SIMILARITY)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated passages; every row stays, if need be with empty text.

    The earliest copy is that of the smallest doc_id, then place; null ids come first. Rows of equal
    doc_id and text share one place, so both keep what is first. Null texts stay null.
    """
    ship(configure(spark))
    return repeats.without_repeats(docs, PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null sources are a source of their own, the last. Texts without words have size 0; the
    order of a source is fixed by its documents' ids and texts, repeated rows in turn. Within a
    source texts are expected in proportion to the share of their words that are different.
    """
    ship(configure(spark))
    return mixing.mixed(docs, weight=mixing.variety(docs["text"]))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins with their documents and text, every byte of which is kept.

    Null sources conflict with nothing; equal texts never share a bin; texts longer than a
    bin are cut between words.
    """
    ship(configure(spark))
    return packing.bins(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The stages train a model and search groups and repeats, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
