"""A corpus pipeline over ``documents``: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir), reads all rows its predecessor kept and gives rows that
are written as Parquet and read again as the next stage's ``docs``.  All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm import language, mixing, packing, simhash, toxicity
from jobscope.llm.common import stored
from jobscope.llm.queries import vocabulary
from jobscope.session import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model of the labels of documents that are not held out.

    Where the labels tell no texts apart, all documents stay.
    """
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    if model.is_constant:
        return docs
    return toxicity.score(docs, model, to="_toxic").where("_toxic < 0.5").drop("_toxic")


def drop_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that could be in one of the languages learned; texts without a letter go."""
    return language.plausible(docs, language.fit_with_floors(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; documents without id stay.

    Near copies share at least 0.8 of their distinct five-word shingles.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat(docs, stored(mixing.mix(docs), "mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the sequence and the place there of each."""
    cut = packing.pieces(docs, *vocabulary())
    kept = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(kept)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_no_language),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

# No stage but the mix's counts can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
