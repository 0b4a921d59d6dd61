"""Runs streams over recorded tables until nothing is left."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or in a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        top = sc.getCheckpointDir()
    return f"{top.rstrip('/')}/streams/{uuid.uuid4().hex}"


#: Folders that ``recorded`` has written and no drained stream has read yet.
_RECORDED: set[str] = set()


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def recorded(df: DataFrame, files: int = 1, files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream: written once, then read file by file. What is written goes when a stream over it is drained."""
    spark, path = df.sparkSession, working_folder(df.sparkSession)
    (df if files == 1 else df.repartition(files)).write.parquet(path)
    _RECORDED.add(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """What an append-mode stream gives, as a table. Its checkpoint and recorded input go at once; the table is read where it was written."""
    spark, path, state = stream.sparkSession, working_folder(stream.sparkSession), working_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    read = {s["description"] for p in query.recentProgress for s in p["sources"]}
    for folder in [state, *(f for f in list(_RECORDED) if any(f.rsplit("/", 1)[-1] in text for text in read))]:
        removed(spark, folder)
        _RECORDED.discard(folder)
    return spark.read.schema(stream.schema).parquet(path)
