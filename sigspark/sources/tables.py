"""Text, CSV, JSON and XML sources and sinks with fixed schemas, and the incremental spectrogram cache."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "dataset string, model string, model_name string, family string, split string, accuracy string, macro_f1 string, weighted_f1 string, notes string"


def read_numeric_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(path, line_no, i, q) of two-column text; lines that aren't numbers go. Lines are numbered within their file."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    parts = F.split(F.trim("line"), r"[,;\s]+")
    rows = rows.withColumns({"i": F.try_element_at(parts, F.lit(1)).try_cast("double"), "q": F.try_element_at(parts, F.lit(2)).try_cast("double")})
    return rows.filter("i is not null and q is not null").drop("line")


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header; a required column that the file lacks is an error."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_metrics(spark: SparkSession, *paths: str) -> DataFrame:
    """Metrics rows of JSON files, each an object, a list of objects, or an object a line; missing files are passed over."""
    out = spark.createDataFrame([], METRICS)
    listed = F.concat(F.lit("["), F.regexp_replace(F.trim("value"), r"\}\s*\n\s*\{", "},{"), F.lit("]"))
    rows = F.from_json(F.when(F.trim("value").startswith("["), F.col("value")).otherwise(listed), f"array<struct<{METRICS.replace(' string', ': string')}>>")
    for path in paths:
        try:
            out = out.unionByName(spark.read.text(path, wholetext=True).select(F.inline(rows)))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def read_clip_metadata(spark: SparkSession, path: str, row_tag: str = "Clip") -> DataFrame:
    """Clip metadata of XML sidecars."""
    schema = "drone string, center_mhz int, sample_rate_hz double, bandwidth_hz double, snr_db double"
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_class_file(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.catalogue import class_table

    return class_table(spark.read.text(path, wholetext=True))


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with a header; doubles with a fixed number of digits, nulls as empty fields."""
    cells = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    cells = [F.when(F.col(c).isNotNull(), x).alias(c) for (c, _), x in zip(df.dtypes, cells, strict=True)]
    df.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def cache_key(*parts: Column) -> Column:
    """sha1 over a source's path, size, time and parameters."""
    return F.sha1(F.concat_ws("|", *parts))


def file_keys(files: DataFrame, *params: Column) -> DataFrame:
    """Files (path, length, modificationTime) with their cache key: a file that has changed, or other parameters, give another one."""
    return files.withColumn("key", cache_key(F.col("path"), F.col("length").cast("string"), F.unix_micros(F.col("modificationTime").cast("timestamp")).cast("string"), *params))


COMMIT = "_commit"


def commit(rows: DataFrame, path: str) -> None:
    """Adds rows to the cache: written aside, under a name that readers pass over, then renamed, which is one step of the file system."""
    spark, name = rows.sparkSession, f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    staged, done = (spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{x}") for x in (f".staged-{name}", f"{COMMIT}={name}"))
    rows.write.parquet(staged.toString())
    if not staged.getFileSystem(spark._jsc.hadoopConfiguration()).rename(staged, done):
        raise OSError(f"{staged} can't be renamed")


def entries(spark: SparkSession, path: str, key: str, valid: Column | None = None) -> DataFrame | None:
    """Rows of the cache; None where it holds nothing yet. Of a key that several writers have added, the first commit counts of
    those whose rows are all valid: so a key has the rows of one writer, and none where it has no valid ones."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    rows = rows.withColumn(COMMIT, F.col(COMMIT).cast("string"))
    good = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    first = rows.groupBy(key, COMMIT).agg(F.min(good).alias("good")).filter("good").groupBy(key).agg(F.min(COMMIT).alias(COMMIT))
    return rows.join(first, [key, COMMIT], "left_semi").drop(COMMIT)


def cleaned(sources: DataFrame, key: str, path: str, valid: Column | None = None) -> None:
    """Leaves in the cache the entries that count for the keys of ``sources``, as one commit: superseded keys, invalid rows, what
    several writers have added, and what killed ones have left aside go. For a time without writers and readers."""
    spark = sources.sparkSession
    rows = entries(spark, path, key, valid)
    if rows is None:
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    before = [f.getPath() for f in system.listStatus(place)]
    commit(rows.join(sources.select(key).distinct(), key, "left_semi"), path)
    for old in before:
        system.delete(old, True)


def cached(sources: DataFrame, key: str, path: str, compute: Callable[[DataFrame], DataFrame], valid: Column | None = None) -> DataFrame:
    """Rows of a Parquet cache for the keys of ``sources``; what it lacks, or holds invalidly, is computed and added.

    Only new keys are computed. A key with a row that fails ``valid`` (null fails) counts as missing. Rows are added by a rename, so
    that a writer that is killed leaves nothing that is read, and of two writers at once one counts for each key.
    """
    spark, wanted = sources.sparkSession, sources.select(key).distinct()
    have = entries(spark, path, key, valid)
    new = sources if have is None else sources.join(have.select(key).distinct(), key, "left_anti")
    if have is None or not new.isEmpty():
        commit(compute(new), path)
    return entries(spark, path, key, valid).join(wanted, key, "left_semi")
