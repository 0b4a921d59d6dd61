"""Exact deduplication over a stream with disk-backed keyed state (DataFrame operations only).

Digest, stable identifier and content locator (file and row) of every text run through a Structured
Streaming aggregation whose state lives in RocksDB and never expires. The locator that a digest's
state ends with names the row that stays. Rows of digests with hits are read again by their locators and
compared by their full bytes, so that a digest collision can't merge different texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, materialise, read_table, scoped, shared_folder

#: State on disk, uploaded by its changes, and without space reserved ahead in each of many small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


PLACE = ["file", "row"]


def scans_files(docs: DataFrame) -> bool:
    """Whether each row of the table is one of a file, found by (file, row) again: a scan with projections and repeatable filters only."""
    plan = docs._jdf.queryExecution().analyzed()
    nodes = {line.lstrip(" :+-!'").split(" ")[0].split("[")[0] for line in plan.treeString().splitlines()}
    return plan.deterministic() and nodes <= {"Project", "Filter", "SubqueryAlias", "Relation"}


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, norm, file, row): where each text stands. Tables that aren't plain scans of files are written first."""
    narrow = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        rows = docs.select(*narrow, *place) if scans_files(docs) else None
    except AnalysisException:
        rows = None
    if rows is None:
        rows = materialise(docs.select(*narrow)).select("doc_id", "text", *place)
    return rows.select("doc_id", ascii_lower(F.col("text")).alias("norm"), *PLACE)


def keyed_state(stream: DataFrame) -> DataFrame:
    """State of the stream of (digest, doc_id, file, row): no watermark, so that no key expires."""
    return stream.groupBy("digest").agg(F.max(F.struct("doc_id", *PLACE)).alias("keep"), F.count(F.lit(1)).alias("group_size"))


def run_to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream of arrivals until nothing is left; return the last state of each digest.

    Every micro-batch writes the keys that it changed to a folder of its own, replaced when the batch
    is repeated. Started again with the same folders, it goes on where it stopped.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        query = (
            keyed_state(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    schema = keyed_state(spark.createDataFrame([], stream.schema)).schema
    changes = spark.read.schema(schema).parquet(f"{path}/batch=*")
    return changes.groupBy("digest").agg(F.max_by("keep", "group_size").alias("keep"), F.max("group_size").alias("group_size"))


@scoped
def exact_dedup(
    docs: DataFrame,
    *,
    key: Callable[[Column], Column] = sha256_key,
    files_per_batch: int = 1000,
    hot_share: int = 1000,
    salts: int = 32,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. One row of each group stays: that of the
    largest doc_id, and of rows that repeat it the last by file and row. Null text counts as empty.
    Rows that repeat a doc_id count one by one in group_size. Null ids never stay before others; in a
    group of null ids only, keep_id is null. An empty table gives no row. Other columns are ignored.

    Groups holding over 1/``hot_share`` of all rows are at most ``hot_share`` in number: they are
    broadcast; all others meet their rows in a shuffled join. Texts of a group are reduced in two steps,
    the first in ``salts`` parts.
    """
    spark = docs.sparkSession
    arrivals, texts = shared_folder(spark), located(docs)
    narrow = texts.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), key(F.col("norm")).alias("digest"), *PLACE)
    narrow.write.parquet(arrivals)
    seen = spark.read.schema(narrow.schema).parquet(arrivals)
    stream = (
        spark.readStream.schema(narrow.schema).option("maxFilesPerTrigger", files_per_batch)
        .parquet(arrivals).select("digest", "doc_id", *PLACE)
    )
    state = materialise(run_to_table(spark, stream, shared_folder(spark), shared_folder(spark)))

    total = seen.count()
    hot = state.filter(F.col("group_size") * hot_share > F.lit(total))
    cold = state.filter(F.col("group_size") * hot_share <= F.lit(total))
    wanted = ["keep", "group_size"]
    rows = ["doc_id", "text_sha256", "digest", *PLACE]
    hot_names = hot.select("digest", F.lit(True).alias("is_hot"), *[F.col(c).alias(f"hot_{c}") for c in wanted])
    marked = seen.join(F.broadcast(hot_names), "digest", "left")
    found = materialise(
        marked.filter("is_hot").select(*rows, *[F.col(f"hot_{c}").alias(c) for c in wanted])
        .unionByName(marked.filter("is_hot is null").select(*rows).join(cold, "digest").select(*rows, *wanted))
    )

    # Full bytes of the hits, read where they stand.
    texts = texts.withColumn("digest", key(F.col("norm")))
    hits = found.filter("group_size > 1").select(*PLACE)
    read = texts.join(hits, PLACE, "left_semi").withColumn("salt", F.spark_partition_id() % salts)
    parts = read.groupBy("digest", "salt").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    doubted = parts.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("digest")
    doubted = materialise(doubted)
    if not doubted.isEmpty():
        clash = texts.join(doubted, "digest", "left_semi")
        groups = clash.groupBy("norm").agg(F.max(F.struct("doc_id", *PLACE)).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        found = found.join(doubted, "digest", "left_anti").unionByName(
            clash.join(groups, "norm").select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "digest", *PLACE, *wanted)
        )
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
