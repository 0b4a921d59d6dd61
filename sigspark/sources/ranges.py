"""Long binary captures as Python data sources: files are read by byte ranges, several tasks a file.

``iq_ranges`` gives blocks of samples, with a halo from the neighbouring blocks if wanted, in batch and, for files that
grow, as a stream. ``iq_replay`` gives the files of a folder again and again as numbered chunks. Files are opened by
``pyarrow.fs``: local ones, and those of the stores that it knows, by their URIs.
"""

from __future__ import annotations

import fnmatch
import math
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .frames import FORMATS, opened

#: Also 16-bit numbers at their own scale.
KINDS = {**FORMATS, "int16": ("<i2", 1.0)}
SAMPLE = pa.struct([("i", pa.float64()), ("q", pa.float64())])
ARROW = {"path": pa.string(), "samples": pa.int64(), "block": pa.int64(), "first": pa.int64(), "own": pa.int64(), "iq": pa.list_(SAMPLE), "seq": pa.int64(), "round": pa.int64()}


@dataclass(frozen=True)
class Layout:
    """How files are cut: ``block`` samples a block, ``before`` and ``after`` samples of halo, ``range_bytes`` a task (more, if there were too many)."""

    folder: str
    pattern: str
    kind: str
    block: int
    before: int
    after: int
    range_bytes: int

    @classmethod
    def of(cls, options: dict) -> Layout:
        number = lambda key, default: int(options.get(key, default))
        kind = options.get("format", "cf32")
        if kind not in KINDS:
            raise ValueError(f"unknown IQ format {kind!r}")
        return cls(options["path"], options.get("pattern", "*"), kind, number("block", 65_536), number("before", 0), number("after", 0), number("rangebytes", 64 << 20))

    @property
    def width(self) -> int:
        return 2 * np.dtype(KINDS[self.kind][0]).itemsize

    def files(self) -> list[tuple[str, str, int]]:
        """(path below the folder, path to open, whole samples), by name; hidden files are passed over."""
        system, top = opened(self.folder)
        found = system.get_file_info(pafs.FileSelector(top, recursive=True))
        names = [(f.path[len(top.rstrip("/")) + 1 :], f) for f in found if f.is_file]
        return sorted((n, f.path, f.size // self.width) for n, f in names if fnmatch.fnmatch(f.base_name, self.pattern) and f.base_name[0] not in "._")

    def samples(self, file: pa.NativeFile, start: int, end: int) -> np.ndarray:
        """Their parts, as two columns."""
        kind, full = KINDS[self.kind]
        file.seek(start * self.width)
        return np.frombuffer(file.read((end - start) * self.width), kind).astype(np.float64).reshape(-1, 2) / full

    def blocks(self, n: int) -> int:
        return -(-n // self.block)


#: (name, path, samples, low, high, round, seq): blocks ``low`` to ``high`` of a file; block k is number ``seq`` + k of a replay.
Part = tuple[str, str, int, int, int, int, int]
#: So many tasks at most are made by ranges under a task's full bytes.
TASKS, FULL = 256, 64 << 20
#: Samples, and rows, that are read and given on together, but for a longer block.
SAMPLES, ROWS = 1 << 18, 10_000


@dataclass
class Range(InputPartition):
    parts: list[Part]

    def __init__(self, parts: list[Part]):
        self.parts = parts


def dealt(layout: Layout, parts: Iterable[Part], blocks: int) -> list[Range]:
    """Ranges of about ``range_bytes``: long stretches of blocks are cut, short ones share a task. Where the ``blocks`` of all parts
    would make over TASKS of them, ranges are longer, up to FULL."""
    each = layout.block * layout.width
    most = max(1, layout.range_bytes // each, min(FULL // each, -(-blocks // TASKS)))
    out, held, room = [], [], most
    for name, path, n, low, high, turn, seq in parts:
        while low < high:
            take = min(high - low, room)
            held.append((name, path, n, low, low + take, turn, seq))
            low, room = low + take, room - take
            if not room:
                out.append(Range(held))
                held, room = [], most
    return [*out, Range(held)] if held else out


def blocks_of(layout: Layout, wanted: list[str], partition: Range) -> Iterator[tuple[dict, np.ndarray | None]]:
    """Cells and samples of each block; blocks that lie together are read together, and without samples among the columns no file is opened."""
    system, step = opened(layout.folder)[0], max(1, SAMPLES // layout.block)
    for name, path, n, low, high, turn, seq in partition.parts:
        file = system.open_input_file(path) if "iq" in wanted else None
        for stretch in range(low, high, step):
            upper = min(high, stretch + step)
            start = max(0, stretch * layout.block - layout.before)
            read = None if file is None else layout.samples(file, start, min(n, min(n, upper * layout.block) + layout.after))
            for block in range(stretch, upper):
                first = max(0, block * layout.block - layout.before)
                own = min(n, (block + 1) * layout.block)
                cells = {"path": name, "samples": n, "block": block, "first": first, "own": own - block * layout.block, "round": turn, "seq": seq + block}
                yield cells, None if read is None else read[first - start : min(n, own + layout.after) - start]
        if file is not None:
            file.close()


def rows_of(layout: Layout, wanted: list[str], partition: Range) -> Iterator[pa.RecordBatch]:
    """Batches of several blocks, of the wanted columns only."""

    def batch() -> pa.RecordBatch:
        columns = []
        for c in wanted:
            if c == "iq":
                ends = np.cumsum([0, *(len(x) for _, x in held)], dtype=np.int32)
                i, q = np.concatenate([x for _, x in held]).T
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(i.copy()), pa.array(q.copy())], names=["i", "q"])))
            else:
                columns.append(pa.array([cells[c] for cells, _ in held], ARROW[c]))
        return pa.RecordBatch.from_arrays(columns, names=wanted)

    held, size = [], 0
    for cells, x in blocks_of(layout, wanted, partition):
        more = 0 if x is None else len(x)
        if held and (size + more > SAMPLES or len(held) == ROWS):
            yield batch()
            held, size = [], 0
        held.append((cells, x))
        size += more
    if held:
        yield batch()


class RangeReader(DataSourceReader):
    """Filters on path and block choose files and ranges; other columns' filters stay with Spark."""

    def __init__(self, layout: Layout, wanted: list[str]):
        self.layout, self.wanted, self.paths, self.blocks = layout, wanted, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in (("path",), ("block",)):
                continue
            if f.attribute == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)):
                self.paths.append(f)
            elif f.attribute == ("block",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.blocks.append(f)
            else:
                yield f

    def fits(self, name: str) -> bool:
        tests = {EqualTo: lambda v: name == v, In: lambda v: name in v, StringStartsWith: name.startswith, StringEndsWith: name.endswith, StringContains: lambda v: v in name}
        return all(tests[type(f)](f.value) for f in self.paths)

    def stretch(self, count: int) -> tuple[int, int]:
        low, high = 0, count
        for f in self.blocks:
            if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                low = max(low, f.value)
            if isinstance(f, GreaterThan):
                low = max(low, f.value + 1)
            if isinstance(f, (EqualTo, LessThanOrEqual)):
                high = min(high, f.value + 1)
            if isinstance(f, LessThan):
                high = min(high, f.value)
        return low, high

    def partitions(self) -> list[Range]:
        parts = [(name, path, n, *self.stretch(self.layout.blocks(n)), 0, 0) for name, path, n in self.layout.files() if self.fits(name)]
        return dealt(self.layout, parts, sum(max(0, p[4] - p[3]) for p in parts)) or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.layout, self.wanted, partition)


class GrowingReader(DataSourceStreamReader):
    """Whole blocks of growing files; an offset is how many blocks of each file have been given out."""

    def __init__(self, layout: Layout, wanted: list[str]):
        self.layout, self.wanted = layout, wanted

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """A block is ready when its samples and its halo are there."""
        ready = ((name, max(0, (n - self.layout.after) // self.layout.block)) for name, _, n in self.layout.files())
        return {name: blocks for name, blocks in ready if blocks}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = {name: (path, n) for name, path, n in self.layout.files()}
        parts = [(name, *files[name], start.get(name, 0), high, 0, 0) for name, high in sorted(end.items())]
        return dealt(self.layout, parts, sum(max(0, p[4] - p[3]) for p in parts))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.layout, self.wanted, partition)


class IqRanges(DataSource):
    """Options: path (folder or its URI), pattern, format (cs8, cs16, cf32, int16), block, before, after, rangeBytes (of a task; over
    256 tasks would take more, up to 64 MB each). Incomplete
    last samples of a file are dropped; an empty file has no row. ``samples`` is the file's length, ``first`` the index of
    the first sample in iq (of the halo, if there is one), ``own`` how many samples the block has without its halo."""

    @classmethod
    def name(cls) -> str:
        return "iq_ranges"

    def schema(self) -> str:
        return "path string, samples long, block long, first long, own long, iq array<struct<i: double, q: double>>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(Layout.of(self.options), schema.names)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return GrowingReader(Layout.of(self.options), schema.names)


class ReplayReader(DataSourceStreamReader):
    """Chunks of the folder's files, one file after the other, ``rounds`` times, numbered through from 0.

    An offset is a number of chunks, so a restarted query goes on where it stopped. With ``rate`` (chunks a second) and
    ``started`` (seconds since 1970), as many are there as the clock says; without ``rounds`` that has no end.
    """

    def __init__(self, layout: Layout, options: dict, wanted: list[str]):
        self.layout, self.wanted = replace(layout, before=0, after=0), wanted
        self.rounds = int(options["rounds"]) if "rounds" in options else None
        self.rate, self.started = float(options.get("rate", 0)), float(options.get("started", 0))
        if self.rounds is None and not self.rate:
            raise ValueError("an endless replay needs a rate")

    def starts(self) -> tuple[list[tuple[str, str, int]], np.ndarray]:
        """The files, and before each how many chunks of a round."""
        files = [f for f in self.layout.files() if f[2]]
        return files, np.cumsum([0, *(self.layout.blocks(n) for _, _, n in files)])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"chunk": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        whole = int(self.starts()[1][-1])
        most = math.inf if self.rounds is None else self.rounds * whole
        due = math.floor((time.time() - self.started) * self.rate) if self.rate else most
        return {"chunk": max(0, int(min(most, due))) if whole else 0}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = start["chunk"], end["chunk"]
        return dealt(self.layout, self.parts(low, high), high - low) if low < high else []

    def parts(self, low: int, high: int) -> Iterator[Part]:
        """Of the files, what has numbers from ``low`` to below ``high``."""
        files, starts = self.starts()
        whole = int(starts[-1])
        for turn in range(low // whole, -(-high // whole)):
            for (name, path, n), before, behind in zip(files, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                seq = turn * whole + before
                first, last = max(0, low - seq), min(behind - before, high - seq)
                if first < last:
                    yield name, path, n, first, last, turn, seq

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from rows_of(self.layout, self.wanted, partition)


class IqReplay(DataSource):
    """A stream of (path, round, seq, first, iq). Options: those of ``iq_ranges`` but for the halo, block being a chunk's samples
    (a file's last one is shorter), and rounds, or rate and started."""

    @classmethod
    def name(cls) -> str:
        return "iq_replay"

    def schema(self) -> str:
        return "path string, round long, seq long, first long, iq array<struct<i: double, q: double>>"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ReplayReader(Layout.of(self.options), self.options, schema.names)


def registered(spark: SparkSession) -> SparkSession:
    """The session with both sources, and with filters pushed down to them."""
    for source in (IqRanges, IqReplay):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def columns_of(wanted: list[str]) -> str:
    kinds = dict(f.strip().split(" ", 1) for f in IqRanges({}).schema().split(", ", 5))
    return ", ".join(f"{c} {kinds[c]}" for c in wanted)


def read_blocks(spark: SparkSession, folder: str, *wanted: str, **options: object) -> DataFrame:
    """Blocks of the captures in a folder: all columns, or only the ``wanted`` ones, which is what is read."""
    reader = registered(spark).read.format("iq_ranges").options(path=folder, **options)
    return (reader.schema(columns_of(list(wanted))) if wanted else reader).load()


def stream_blocks(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    return registered(spark).readStream.format("iq_ranges").options(path=folder, **options).load()


def replayed_chunks(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    return registered(spark).readStream.format("iq_replay").options(path=folder, **options).load()


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int]]:
    """(file, first row, end) of rows that follow each other in a file, of SAMPLES together at most, or a row."""
    names, sizes = batch.column(0).to_pylist(), batch.column(2).value_lengths().to_pylist()
    start, held = 0, 0
    for row, (name, size) in enumerate(zip(names, sizes, strict=True)):
        if row > start and (name != names[start] or held + (size or 0) > SAMPLES):
            yield names[start], start, row
            start, held = row, 0
        held += size or 0
    if names:
        yield names[start], start, len(names)


def write_captures(blocks: DataFrame, folder: str, file: str, order: str, kind: str = "cf32") -> int:
    """Writes (file, order, iq) rows as one binary file per name in ``file``; a task appends its files' blocks as they come, those that follow each other in a batch together (up to SAMPLES, or one block).

    Returns how many files there are. A file appears under its name when it is whole; a repeated task writes it anew.
    """
    number, full = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        system.create_dir(top, recursive=True)
        out, name, written = None, None, []

        def close() -> None:
            if name is not None:
                out.close()
                system.move(f"{top}/.{name}.part", f"{top}/{name}")
                written.append(name)

        for batch in batches:
            for own, start, end in stretches(batch):
                if own != name:
                    close()
                    name, out = own, system.open_output_stream(f"{top}/.{own}.part")
                samples = batch.column(2).slice(start, end - start).flatten()
                pairs = np.stack([samples.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)], 1) * full
                out.write((np.rint(pairs) if number != "<f4" else pairs).astype(number).tobytes())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], names=["name"])

    rows = blocks.select(file, order, "iq").repartition(file).sortWithinPartitions(file, order)
    return rows.mapInArrow(run, "name string").count()
