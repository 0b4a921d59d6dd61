"""Numpy kernels over the complex windows of an Arrow batch: windows of one length go through a kernel together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], dict[str, np.ndarray]]
TYPES = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def split_channels(windows: DataFrame, key: str) -> DataFrame:
    return windows.select(key, F.transform("iq", lambda s: s.i).alias("i"), F.transform("iq", lambda s: s.q).alias("q"))


def by_length(i: pa.Array, q: pa.Array, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, windows x samples) for each length; null windows and those of under ``least`` samples are left out, null samples are NaN."""
    lengths = pc.fill_null(pc.list_value_length(i), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    parts = [c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (i, q)]
    for n in np.unique(lengths[lengths >= least]):
        rows = np.flatnonzero(lengths == n)
        at = starts[rows][:, None] + np.arange(n)
        yield rows, parts[0][at] + 1j * parts[1][at]


def column(values: np.ndarray, kind: str) -> pa.Array:
    if kind != "array<double>":
        return pa.array(values.ravel()).cast(TYPES[kind])
    flat = np.ascontiguousarray(values, float).reshape(-1, values.shape[-1])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def batched(windows: DataFrame, kernel: Kernel, fields: dict[str, str], key: str = "capture_id", least: int = 1) -> DataFrame:
    """(key, fields) from (key, iq) rows, with no shuffle.

    The kernel gets windows of one length and gives, for each field, windows x rows of a window (x values, for arrays).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch.column(1), batch.column(2), least):
                with np.errstate(all="ignore"):
                    out = kernel(x)
                times = out[next(iter(fields))].shape[1]
                keys = batch.column(0).take(pa.array(np.repeat(rows, times)))
                yield pa.RecordBatch.from_arrays([keys, *(column(out[f], kind) for f, kind in fields.items())], names=[key, *fields])

    split = split_channels(windows, key)
    return split.mapInArrow(run, f"{key} {dict(split.dtypes)[key]}, " + ", ".join(f"{f} {kind}" for f, kind in fields.items()))
