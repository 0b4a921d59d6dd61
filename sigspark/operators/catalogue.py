"""Capture catalogues: names, labels, signal-to-noise ratios, class tables, manifests and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names and paths as capture tools write them.
NOISY_NAME = r"^IQdata_sample(\d+)_target(-?\d+)_snr(-?\d+)\.pt$"
RML_NAME = r"RML2016_([^/]+?)_snr(-?\d+)_sample(\d+)"
SNR_PATTERNS = (r"(?i)snr[_=\- ]*(-?\d+(?:\.\d+)?)", r"(?i)(-?\d+(?:\.\d+)?)\s*dB", r"(?i)dB[_=\- ]*(-?\d+(?:\.\d+)?)")
IQ_SUFFIXES = (".iq", ".bin", ".dat", ".npy", ".npz", ".c64", ".complex64", ".csv", ".txt")


def matched(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null where nothing matches."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_noisy_names(df: DataFrame, path: str = "filepath", *, strict: bool = False) -> DataFrame:
    """Adds sample_id, target_raw and snr from the file name. Other names get nulls, or an error if ``strict``."""
    name = basename(F.col(path))
    parts = {c: matched(name, NOISY_NAME, k).cast("int") for k, c in enumerate(("sample_id", "target_raw", "snr"), 1)}
    if strict:
        wrong = F.raise_error(F.concat(F.lit("not a capture name: "), F.coalesce(name, F.lit("null"))))
        parts["sample_id"] = F.when(F.coalesce(F.regexp_like(name, F.lit(NOISY_NAME)), F.lit(False)), parts["sample_id"]).otherwise(wrong.cast("int"))
    return df.withColumns(parts)


def parse_rml_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds modulation, snr and sample from names like RML2016_QPSK_snr-4_sample7."""
    c = F.col(name)
    return df.withColumns({"modulation": matched(c, RML_NAME, 1), "snr": matched(c, RML_NAME, 2).cast("int"), "sample": matched(c, RML_NAME, 3).cast("int")})


def infer_snr(*texts: Column) -> Column:
    """The first number that a pattern finds, texts in order, and patterns in order within a text; else null."""
    return F.coalesce(*[matched(t, p, 1).cast("double") for t in texts for p in SNR_PATTERNS])


def safe_label(archive: Column) -> Column:
    """A class label from an archive's name: stem, white space to _, only letters, digits, _ and -."""
    stem = F.trim(F.regexp_replace(basename(archive), r"\.[^.]*$", ""))
    clean = F.regexp_replace(F.regexp_replace(stem, r"\s+", "_"), r"[^A-Za-z0-9_-]", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def indexed(values: DataFrame, column: str, index: str) -> DataFrame:
    """Distinct non-null values of a column, numbered from 0 in their order: one row per class."""
    distinct = values.select(column).filter(F.col(column).isNotNull()).distinct()
    return distinct.withColumn(index, F.row_number().over(Window.orderBy(column)) - 1)


def label_index(df: DataFrame, column: str = "target_raw", index: str = "label_idx") -> DataFrame:
    """Adds the place of each label among the sorted distinct labels of ``df``. The class table is small: as many rows as classes."""
    return df.join(indexed(df, column, index), column, "left")


def onehot_index(onehot: Column) -> Column:
    """Place of the first largest entry, from 0."""
    return (F.array_position(onehot, F.array_max(onehot)) - 1).cast("int")


def class_table(df: DataFrame, text: str = "value") -> DataFrame:
    """(class_idx, class_name) rows from the text of a ``classes = [...]`` file."""
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)=\s*(\[.*\])", 1), "'", '"')
    return df.select(F.posexplode(F.from_json(body, "array<string>")).alias("class_idx", "class_name"))


def named_classes(df: DataFrame, classes: DataFrame, column: str = "class_int") -> DataFrame:
    """Adds class_name; classes that the table lacks are called target_<id>."""
    names = classes.select(F.col("class_idx").alias(column), "class_name")
    joined = df.join(F.broadcast(names), column, "left")
    return joined.withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("target_"), F.col(column))))


def remapped_classes(source: DataFrame, target: DataFrame) -> DataFrame:
    """(class_idx, class_name, new_idx): each class's place in another order of the same names."""
    return source.join(target.select("class_name", F.col("class_idx").alias("new_idx")), "class_name")


def global_labels(*datasets: tuple[str, DataFrame]) -> DataFrame:
    """(dataset, class_idx, global_label, global_idx) of several class tables; labels are dataset:class, numbered in order."""
    rows = None
    for name, classes in datasets:
        part = classes.select(F.lit(name).alias("dataset"), "class_idx", F.concat(F.lit(f"{name}:"), "class_name").alias("global_label"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(indexed(rows, "global_label", "global_idx"), "global_label")


def snr_slice(df: DataFrame, *, low: float | None = None, above: float | None = None, high: float | None = None, column: str = "snr") -> DataFrame:
    """Rows with snr >= low, > above and <= high, as far as they are given. Null never passes a bound."""
    for test in [] + [F.col(column) >= low] * (low is not None) + [F.col(column) > above] * (above is not None) + [F.col(column) <= high] * (high is not None):
        df = df.filter(test)
    return df


def at_max_snr(df: DataFrame, column: str = "snr") -> DataFrame:
    """Rows at the largest ratio: one small aggregate, broadcast."""
    return df.join(F.broadcast(df.agg(F.max(column).alias(column))), column, "left_semi")


def top_snr_levels(df: DataFrame, levels: int = 8, column: str = "snr") -> DataFrame:
    """Rows at the ``levels`` largest distinct ratios. Rows without one stay only if no row has any."""
    known = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(F.desc(column)).limit(levels)
    any_known = known.agg((F.count(F.lit(1)) > 0).alias("any_known"))
    kept = known.select(F.col(column).alias("level"))
    joined = df.crossJoin(F.broadcast(any_known)).join(F.broadcast(kept), F.col(column) == F.col("level"), "left")
    return joined.filter(F.col("level").isNotNull() | (~F.col("any_known") & F.col(column).isNull())).select(*df.columns)


def iq_files(df: DataFrame, path: str = "filepath") -> DataFrame:
    return df.filter(suffix(F.col(path)).isin(*IQ_SUFFIXES))


FLOAT_MAX = 3.4028234663852886e38


def clean_number(x: Column) -> Column:
    """NaN and null to 0; infinities to the largest single-precision numbers."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).when(x == float("inf"), FLOAT_MAX).when(x == float("-inf"), -FLOAT_MAX).otherwise(x)


def strict_number(text: Column) -> Column:
    """0 for what isn't a finite number within single precision."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) > FLOAT_MAX), 0.0).otherwise(x)


def padded_row(values: Column, width: int) -> Column:
    """First entries of sequences, cleaned, filled up with zeros to ``width``."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.coalesce(strict_number(F.try_element_at(values, k)), F.lit(0.0)))


def repaired(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """A manifest (filepath, label) with paths that exist under their label in the listing (path, label).

    Rows whose path exists under their label stay; under another label they go. A missing path is
    replaced by the first path with the same file name and label, or goes. File names repeat in every
    class, so the key of the repair holds the label too.
    """
    files = listing.select(F.col("path"), F.col("label").alias("file_label")).distinct()
    marked = manifest.join(files, F.col("filepath") == F.col("path"), "left")
    fine = marked.filter("path is not null and file_label = label").select(*manifest.columns)
    lost = marked.filter("path is null").select(*manifest.columns)
    first = files.groupBy(basename(F.col("path")).alias("base"), F.col("file_label").alias("label")).agg(F.min("path").alias("found"))
    mended = lost.withColumn("base", basename(F.col("filepath"))).join(first, ["base", "label"]).withColumn("filepath", F.col("found"))
    return fine.unionByName(mended.select(*manifest.columns))


def label_conflicts(manifest: DataFrame, examples: int = 5, labels: int = 8) -> DataFrame:
    """Files with several labels: (filepath, n_labels, labels), the first few by path."""
    several = manifest.groupBy("filepath").agg(F.countDistinct("label").alias("n_labels"), F.sort_array(F.collect_set("label")).alias("labels"))
    return several.filter("n_labels > 1").withColumn("labels", F.slice("labels", 1, labels)).orderBy("filepath").limit(examples)


def missing_artifacts(expected: DataFrame, found: DataFrame, column: str = "path") -> DataFrame:
    return expected.join(found.select(column).distinct(), column, "left_anti")


def models_without_dataset(models: DataFrame, datasets: DataFrame) -> DataFrame:
    return models.join(datasets.select(F.col("name").alias("dataset")), "dataset", "left_anti")


def existing_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    return manifest.join(listing.select(F.col("path").alias("filepath")), "filepath", "left_semi")


def clip_summary(clips: DataFrame) -> DataFrame:
    """Per drone: clips, map of centre MHz to count, and the range of rate, bandwidth and ratio."""
    centres = clips.groupBy("drone", "center_mhz").agg(F.count(F.lit(1)).alias("n"))
    maps = centres.groupBy("drone").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("center_mhz", "n")))).alias("centers"))
    bounds = [f(c).alias(f"{n}_{c}") for c in ("sample_rate_hz", "bandwidth_hz", "snr_db") for n, f in (("min", F.min), ("max", F.max))]
    return clips.groupBy("drone").agg(F.count(F.lit(1)).alias("clips"), *bounds).join(maps, "drone")
