"""Shared pieces of the training-data operators: folders, hashed folds, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Paths of the innermost ``scratch`` that is open.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share; an open ``scratch`` removes it at its end.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where neither that setting nor a
    checkpoint folder is there (tests, one machine) a temporary folder is set.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        top = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(top)
        top = sc.getCheckpointDir()
    path = f"{top.rstrip('/')}/tables/{uuid.uuid4().hex}"
    paths = _SCOPE.get()
    if paths is not None:
        paths.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that no later step reads."""
    for table in tables:
        path = table.__dict__.pop("table_path", None)
        if path:
            remove(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """The tables that are materialised inside go at its end, but for what is passed through the function
    that it yields: that is written for whoever is outside."""
    outer, paths = _SCOPE.get(), []

    def keep(df: DataFrame) -> DataFrame:
        inside = _SCOPE.set(outer)
        try:
            return materialise(df)
        finally:
            _SCOPE.reset(inside)

    opened = _SCOPE.set(paths)
    try:
        yield keep
    finally:
        _SCOPE.reset(opened)
        for path in paths:
            remove(spark, path)


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a table that leaves nothing on the shared folder but its result, which is written there."""

    @wraps(operator)
    def run(*args: object, **options: object) -> DataFrame:
        table = next(x for x in (*args, *options.values()) if isinstance(x, DataFrame))
        with scratch(table.sparkSession) as keep:
            return keep(operator(*args, **options))

    return run


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    For pure ASCII ``lower`` does the same as ``translate`` and is many times faster.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """``df`` with gapless numbers from 0 in the given order; rows that tie follow each other in any order.

    One range shuffle: a serial number ends the order, so that no key, however many rows have it, has to
    stay in one partition. Sizes of partitions (as many as ``spark.sql.shuffle.partitions``) give the starts.
    """
    tied = materialise(df.withColumn("_serial", F.monotonically_increasing_id()))
    placed = materialise(tied.orderBy(*order, "_serial").drop("_serial").withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows")
    starts = sizes.select("_part", before.alias("_start"))
    row = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*df.columns, row.alias(name))


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % parts).cast("int")


def hashed_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """The first ``most`` rows in an order by the hash of keys.

    A count tells which part of the hash's range holds a few more than that; the rest is filtered out
    first, so that all tasks together pass on little more than the sample. Where many rows repeat few keys,
    that part can hold too few: then all rows are ordered.
    """
    order, n = F.xxhash64(*keys), df.count()
    share = (most + 8 * most**0.5 + 10) / max(1, n)
    if share < 1:
        few = df.filter(order < F.lit(int(-(2**63) + share * 2**64))).orderBy(order, *keys).limit(most)
        if few.count() == most:
            return few
    return df.orderBy(order, *keys).limit(most)


def text_bytes(column: pa.Array, rows: int = 128) -> Iterator[bytes]:
    """UTF-8 bytes of each text, of a few rows at a time; null gives empty bytes."""
    for at in range(0, len(column), rows):
        for value in column.slice(at, rows).cast(pa.large_binary()).to_pylist():
            yield value or b""


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``most`` bytes of a text column at most, or of one row: very long texts don't add up in a task."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > at and held + size > most:
                yield batch.slice(at, row - at)
                at, held = row, 0
            held += size
        yield batch.slice(at)


def ship_arrays(spark: SparkSession, arrays: dict[str, np.ndarray]) -> Callable[[], dict[str, np.ndarray]]:
    """Hand arrays to all executors as one file; those that start later fetch it too.

    Called in a task, the result memory-maps them, so that the workers of a machine share their pages.
    The driver's copy, which executors fetch, is among the files that Spark removes at its end.
    """
    path = SparkFiles.get(name := f"arrays-{uuid.uuid4().hex}.bin")
    layout = []
    with open(path, "wb") as f:
        f.write(bytes(8))
        for key, x in arrays.items():
            f.write(bytes(-f.tell() % 8))
            layout.append((key, x.dtype.str, f.tell(), x.nbytes))
            np.ascontiguousarray(x).tofile(f)
    spark.sparkContext.addFile(path)

    def load() -> dict[str, np.ndarray]:
        whole = np.asarray(np.memmap(SparkFiles.get(name), np.uint8, "r"))
        return {key: whole[at : at + size].view(kind) for key, kind, at, size in layout}

    return load


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
