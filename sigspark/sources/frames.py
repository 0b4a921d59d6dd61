"""Binary captures: files and stream frames, decoded with numpy inside the tasks."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes per sample of one channel, and what full scale is.
FORMATS = {"cs8": ("<i1", 128.0), "cs16": ("<i2", 32768.0), "cf32": ("<f4", 1.0)}
SCHEMA = "path string, iq array<struct<i: double, q: double>>"


def decode_frame(payload: bytes, iq_format: str, channels: int = 1) -> np.ndarray:
    """Complex samples of channel 0; an incomplete tail is dropped. Unknown formats are an error."""
    if iq_format not in FORMATS:
        raise ValueError(f"unknown IQ format {iq_format!r}")
    kind, full = FORMATS[iq_format]
    size = np.dtype(kind).itemsize * 2 * channels
    raw = np.frombuffer((payload or b"")[: len(payload or b"") // size * size], kind).astype(np.float64) / full
    raw = raw.reshape(-1, channels, 2)[:, 0]
    return raw[:, 0] + 1j * raw[:, 1]


def as_complex(x: np.ndarray) -> np.ndarray:
    """Complex samples from complex, interleaved, (n, 2), or (2, n) arrays; higher ranks are flattened first."""
    x = np.asarray(x)
    if np.iscomplexobj(x):
        return x.ravel()
    if x.ndim > 2:
        x = x.reshape(x.shape[0], -1) if x.shape[0] == 2 else x.reshape(-1, x.shape[-1])
    if x.ndim == 1:
        x = x[: len(x) // 2 * 2].reshape(-1, 2)
    elif x.shape[0] == 2 and x.shape[1] != 2:
        x = x.T
    return x[:, 0].astype(float) + 1j * x[:, 1].astype(float)


def decode_file(path: str, content: bytes) -> np.ndarray:
    """Samples of a .npy, .npz (iq, then x, then the first entry), raw complex64 or interleaved .iq file."""
    name = path.lower()
    if name.endswith(".npy"):
        return as_complex(np.load(io.BytesIO(content), allow_pickle=False))
    if name.endswith(".npz"):
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            key = next((k for k in ("iq", "x") if k in z.files), z.files[0])
            return as_complex(z[key])
    if name.endswith(".iq"):
        return decode_interleaved(content)
    return np.frombuffer(content[: len(content) // 8 * 8], "<c8").astype(complex)


def decode_interleaved(content: bytes) -> np.ndarray:
    """Single-precision pairs; with under four values, or any that aren't finite, read as 16-bit numbers instead, at their own scale."""
    x = np.frombuffer(content[: len(content) // 4 * 4], "<f4")
    if len(x) < 4 or not np.isfinite(x).all():
        x = np.frombuffer(content[: len(content) // 2 * 2], "<i2").astype(np.float32)
    c = as_complex(x)
    return c[np.isfinite(c.real) & np.isfinite(c.imag)]


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length and modification time of files by name pattern, at any depth; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime")


def decoded_files(files: DataFrame, least: int = 0) -> DataFrame:
    """(path, iq) from (path, content); zero-padded to ``least`` samples. Broken and null contents have a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("i", pa.float64()), ("q", pa.float64())]))
        for batch in batches:
            rows: list[np.ndarray | None] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    x = decode_file(path, content)
                except (ValueError, OSError, EOFError, KeyError, TypeError):
                    rows.append(None)
                    continue
                rows.append(np.pad(x, (0, max(0, least - len(x)))))
            ends = np.cumsum([0, *(0 if x is None else len(x) for x in rows)])
            flat = np.concatenate([np.empty(0, complex), *(x for x in rows if x is not None)])
            pairs = pa.StructArray.from_arrays([pa.array(flat.real.copy()), pa.array(flat.imag.copy())], names=["i", "q"])
            iq = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, mask=pa.array([x is None for x in rows], pa.bool_())).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), iq], names=["path", "iq"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_iq_files(spark: SparkSession, folder: str, pattern: str = "*", least: int = 0) -> DataFrame:
    """(path, iq) of capture files by name pattern, at any depth."""
    return decoded_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder), least)


def decoded_frames(frames: DataFrame) -> DataFrame:
    """Frames (with iq_format, channels and payload) with the samples of channel 0 as i and q in place of the payload; works on streams too."""
    kept = [c for c in frames.columns if c not in ("iq_format", "channels", "payload")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("payload", "iq_format", "channels")]
            rows = [decode_frame(*r) for r in zip(*own, strict=True)]
            ends, flat = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), np.concatenate([np.empty(0, complex), *rows])
            parts = [pa.ListArray.from_arrays(ends, pa.array(x.copy())) for x in (flat.real, flat.imag)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *parts], names=[*kept, "i", "q"])

    kinds = dict(frames.dtypes)
    return frames.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "i array<double>, q array<double>"]))


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI as Spark writes it, and the path there: local ones, and the stores that ``pyarrow.fs`` knows."""
    if ":" not in path.split("/", 1)[0]:
        return pafs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    return (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def below(spark: SparkSession, path: Column, folder: str) -> Column:
    """A path relative to a folder that it lies in: what follows the folder's name, by length."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/")
    head = F.length(F.regexp_extract(path, "^[^:/]+:(//[^/]*)?", 0))
    return F.substring(path, head + F.lit(len(whole) + 2), F.length(path))


def digests(files: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """(name, sha256) from (name, path): each file is read in pieces by a task, and no content gets into a row. Null where it can't be read."""

    def digest(path: str) -> str | None:
        system, at = opened(path)
        found = hashlib.sha256()
        try:
            with system.open_input_stream(at) as stream:
                while part := stream.read(piece):
                    found.update(part)
        except OSError:
            return None
        return found.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(p) for p in batch.column(1).to_pylist()], pa.string())], names=["name", "sha256"])

    return files.select("name", "path").mapInArrow(run, "name string, sha256 string")


def checksums(spark: SparkSession, expected: DataFrame, folder: str) -> DataFrame:
    """(path, sha256) of expected files (path relative to the folder), null for missing ones. Only those are read, of any size."""
    listed = list_files(spark, folder)
    listed = listed.select("path", below(spark, F.col("path"), folder).alias("name"))
    found = digests(listed.join(expected.select(F.col("path").alias("name")).distinct(), "name"))
    return expected.join(found.withColumnRenamed("name", "path"), "path", "left")
