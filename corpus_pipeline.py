"""The corpus pipeline: language ID, exact and near deduplication, mixing, encoding.

Each stage works on all rows that the one before it kept, by rows and not by ids: where ids are null
or repeated, rows are numbered first. Between stages, rows are written as Parquet to the shared folder
and read again. Run by ``run``, a stage's own tables go when its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.bpe_transducer import default_vocabulary, encode_documents
from sigspark.llm.common import discard, materialise, read_table, scratch
from sigspark.llm.exact_dedup import exact_dedup
from sigspark.llm.language_id import accepted
from sigspark.llm.minhash_dedup import near_duplicates
from sigspark.llm.mixing import repeated

ROW = "pipeline_row"


def one_of_each(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], group: str, largest: bool) -> DataFrame:
    """One row of each group of ``docs``: that of the largest id, or the smallest.

    ``judge`` gives doc_id, kept and the group's name. Unique ids are used as they are. Otherwise rows get
    numbers in their place, and the best of a group is that of the best id, then number; a null id is behind all others.
    """
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        kept = judge(docs).filter("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    numbered = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()))
    judged = judge(numbered.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), F.col(group).alias("group"))
    known = F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull()
    best = (F.max if largest else F.min)(F.struct(known, "doc_id", ROW))
    chosen = judged.join(numbered.select(ROW, "doc_id"), ROW).groupBy("group").agg(best[ROW].alias(ROW))
    return numbered.join(chosen, ROW, "left_semi").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter are rejected; the rest go on, with the predicted language where
    ``lang`` is null. Where no row has a language to learn from, ``lang`` stays as it is."""
    return accepted(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest id stays."""
    return one_of_each(docs, exact_dedup, "keep_id", largest=True)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row with the smallest id stays (of null ids only, any of them)."""
    return one_of_each(docs, near_duplicates, "component_id", largest=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; those of small sources come up to twice, and a third time only to fill a last partial pass."""
    return repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests."""
    encoded = encode_documents(docs, default_vocabulary())
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact),
    ("minhash_dedup", drop_near),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Language ID, the exponent's bisection and BPE are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as written:
            before, docs = docs, written(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
