"""Cleaning pipeline over documents: toxicity, exact and near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. A stage deletes the
scratch tables of the stage before it in the same chain, whose result is written by then, and no others.

Defined results: documents may be empty, texts null, ids null or repeated, and other columns are
carried along whatever their names; what each stage makes of them its operator says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenread.llm import common, exact_dedup, minhash_dedup, packing, suffix_dedup, toxicity


#: Scratch tables of the stages called one after the other, by themselves, since the last first stage.
_stages: list[common.Scope] = []


def staged(first: bool = False):
    """A stage in a scope of its own. It starts with its predecessor's result, so it deletes that one's scratch tables."""

    def of(work: Callable) -> Callable:
        @wraps(work)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if first:
                _stages.clear()  # another run's; they aren't this one's to delete
            while _stages:
                _stages.pop().clear(spark)
            _stages.append(common.Scope())
            with _stages[-1].open():
                return work(spark, docs, sf_dir)

        return run_stage

    return of


@staged(first=True)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on this stage's labelled documents, doesn't predict to be toxic."""
    return toxicity.drop_toxic(docs, common.read(spark, sf_dir, "labels"))


@staged()
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


@staged()
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return minhash_dedup.drop_near_copies(docs)


@staged()
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that repeat; n_chars follows."""
    return suffix_dedup.remove_repeats(docs)


@staged()
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences; a document without text left is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Networks, confirmed links and vocabularies have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents."""
    docs = common.read(spark, sf_dir, "documents")
    written: list[str] = []
    for name, stage in STAGES[:-1]:
        path = common.stage_path(spark, name)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        while written:
            common.delete(spark, written.pop())
        written.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)
