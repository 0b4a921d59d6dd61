"""Language identification with string kernels.

Blended-spectrum presence kernel over byte n-grams of the lower-cased text, k(x, y) = |P(x) & P(y)| /
sqrt(|P(x)| |P(y)|); a Nystroem map over landmark texts; one-versus-rest kernel ridge regression.
Texts are scored in batches: presence rows x landmark incidence x weights.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, fold_of, materialise, read_table, scratch

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """At most ``per_lang`` labelled rows of each language are learnt from, and ``landmarks`` of them span the
    map: fewer where that would be over ``most_rows`` or ``most_landmarks`` in all, but one of each language.
    Of more than ``most_landmarks`` languages, the most frequent are learnt, of equals the alphabetically first."""

    per_lang: int = 300
    landmarks: int = 40
    most_rows: int = 20_000
    most_landmarks: int = 1_000
    widths: tuple[int, ...] = (1, 2, 3)
    ridge: float = 1e-4
    parts: int = 4
    held: int = 2

    def shares(self, langs: int) -> tuple[int, int]:
        """Rows and landmarks of each language."""
        rows = max(1, min(self.per_lang, self.most_rows // langs))
        return rows, max(1, min(self.landmarks, self.most_landmarks // langs, rows))


def codes_of(text: bytes, width: int) -> np.ndarray:
    """Packed byte n-grams of a text, with repeats."""
    raw = np.frombuffer(text, np.uint8).astype(np.int32)
    if len(raw) < width:
        return np.empty(0, np.int32)
    code = raw[: len(raw) - width + 1].copy()
    for i in range(1, width):
        code <<= 8
        code |= raw[i : len(raw) - width + 1 + i]
    return code


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b" "


class Presence:
    """Looks up the distinct n-grams of texts in a model's n-grams, by direct tables: of 16 bits where these number all n-grams.

    Distinct n-grams of one and two bytes are told by stamps, longer ones by sorting, as stamps would be another large table a worker.
    """

    def __init__(self, widths: tuple[int, ...], grams: list[np.ndarray]):
        self.widths, self.tables, self.stamps, start = widths, [], [], 0
        kind = np.int16 if sum(map(len, grams)) < 1 << 15 else np.int32
        for width, codes in zip(widths, grams, strict=True):
            table = np.full(1 << (8 * width), -1, kind)
            table[codes] = np.arange(start, start + len(codes))
            self.tables.append(table)
            self.stamps.append(np.zeros(1 << (8 * width), np.int32) if width < 3 else None)
            start += len(codes)

    def __call__(self, text: bytes) -> tuple[list[np.ndarray], int]:
        """Numbers of the model's n-grams in the text, and how many distinct n-grams it has."""
        found, distinct = [], 0
        for width, table, stamp in zip(self.widths, self.tables, self.stamps, strict=True):
            code = codes_of(text, width)
            if stamp is None:
                code = np.unique(code)
                distinct += len(code)
            else:
                order = np.arange(len(code), dtype=np.int32)
                stamp[code] = order  # the last writer of each n-gram stands for it
                distinct += int(np.count_nonzero(stamp[code] == order))
            known = table[code]
            found.append(known[known >= 0])
        return found, distinct


def presence_rows(texts: list[bytes], look: Presence, size: int) -> np.ndarray:
    rows = np.zeros((len(texts), size), np.float32)
    for row, text in zip(rows, texts, strict=True):
        found, distinct = look(text)
        for ids in found:
            row[ids] = 1
        row /= max(1.0, distinct) ** 0.5
    return rows


class Landmarks:
    """The n-grams of landmark texts, and the kernel between texts and them."""

    def __init__(self, sets: list[list[np.ndarray]], widths: tuple[int, ...]):
        """From each landmark's distinct n-grams of each width."""
        self.widths = widths
        self.grams = [np.unique(np.concatenate([own[k] for own in sets])) for k in range(len(widths))]
        self.incidence, start = np.zeros((sum(map(len, self.grams)), len(sets)), np.float32), 0
        for k, codes in enumerate(self.grams):
            for i, own in enumerate(sets):
                self.incidence[start + np.searchsorted(codes, own[k]), i] = 1
            start += len(codes)
        self.incidence /= np.sqrt(np.maximum(1, self.incidence.sum(0, keepdims=True)))

    def kernel(self, texts: list[bytes], look: Presence, weights: np.ndarray | None = None, rows: int = 128) -> np.ndarray:
        """Texts x landmarks, or texts x languages with the weights."""
        right = lambda x: x @ self.incidence if weights is None else x @ self.incidence @ weights
        parts = [right(presence_rows(texts[i : i + rows], look, len(self.incidence))) for i in range(0, len(texts), rows)]
        return np.concatenate(parts) if parts else np.empty((0, 0), np.float32)


def solve(kernel: np.ndarray, among: np.ndarray, labels: np.ndarray, langs: list[str], ridge: float) -> np.ndarray:
    """Weights of one-versus-rest ridge regression in the landmarks' map."""
    kernel = kernel.astype(np.float64)
    target = np.where(labels[:, None] == np.array(langs), 1.0, -1.0)
    left = kernel.T @ kernel + ridge * len(kernel) * (among + among.T) / 2 + 1e-8 * np.eye(len(among))
    return np.linalg.lstsq(left, kernel.T @ target, rcond=None)[0]


def learn(docs: DataFrame, settings: Settings) -> Model | None:
    """Fit on the first rows of each language in an order by the hash of id and text.

    A language's count tells which part of the hash's range holds a few more than are wanted; only these are ranked. Where
    rows that repeat each other leave a language fewer than that, its different rows are ranked without the cut. Tasks reduce
    texts to n-gram sets of landmarks, and to kernel values: the driver gets ``most_landmarks`` sets and ``most_rows`` x
    ``most_landmarks`` numbers at most.
    """
    fold = fold_of(F.col("doc_id"), settings.parts)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (fold != settings.held))
    key = ["lang", "doc_id", "mark"]
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.xxhash64("text").alias("mark"), "text")
    common = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(settings.most_landmarks)
    counts = {r.lang: r.n for r in common.collect()}
    langs = sorted(counts)
    if not langs:
        return None
    spark, (rows, marks) = docs.sparkSession, settings.shares(len(langs))
    most = rows + 8 * rows**0.5 + 10
    limits = spark.createDataFrame([(g, min(2**63 - 1, int(-(2**63) + most / n * 2**64))) for g, n in counts.items()], "lang string, limit long")
    place = F.xxhash64("doc_id", "mark")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id", "mark"))
    ranked = lambda df: df.select(*key, rank.alias("rank")).filter(F.col("rank") <= rows)
    chosen = ranked(known.join(F.broadcast(limits), "lang").filter(place <= F.col("limit"))).collect()
    found = Counter(r.lang for r in chosen)
    short = [g for g in langs if found[g] < min(rows, counts[g])]
    if short:
        again = known.filter(F.col("lang").isin(short)).select(*key).distinct()
        chosen = [r for r in chosen if r.lang not in set(short)] + ranked(again).collect()
    wanted = spark.createDataFrame([tuple(r) for r in chosen], "lang string, doc_id long, mark long, rank int")
    texts = materialise(known.join(F.broadcast(wanted.dropDuplicates(key)), key).dropDuplicates(["lang", "rank"]).select("lang", "rank", "text"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            sets = [[np.unique(codes_of(prepared(t), w)) for w in settings.widths] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.list_(pa.int32())))], names=["lang", "rank", "sets"])

    found = texts.filter(F.col("rank") <= marks).mapInArrow(sets_of, "lang string, rank int, sets array<array<int>>").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    landmarks = Landmarks([[np.array(x, np.int32) for x in own] for own in found.column("sets").to_pylist()], settings.widths)
    order = dict(zip(zip(found.column("lang").to_pylist(), found.column("rank").to_pylist(), strict=True), range(len(found)), strict=True))
    shared = spark.sparkContext.broadcast(landmarks)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, look = shared.value, None
        for batch in bounded(batches, 2):
            look = look or Presence(marks.widths, marks.grams)
            values = marks.kernel([prepared(t) for t in batch.column(2).to_pylist()], look)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(values), pa.list_(pa.float32()))], names=["lang", "rank", "kernel"])

    out = texts.mapInArrow(kernels, "lang string, rank int, kernel array<float>").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    labels, kernel = out.column("lang").to_pylist(), np.array(out.column("kernel").to_pylist(), np.float32)
    among = np.zeros((len(order), len(order)))
    for row, k in zip(kernel, zip(labels, out.column("rank").to_pylist(), strict=True), strict=True):
        if k in order:
            among[order[k]] = row
    return Model(langs, landmarks, solve(kernel, among, np.array(labels), langs, settings.ridge).astype(np.float32))


@dataclass
class Model:
    langs: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # landmark x language

    def predict(self, texts: list[str], look: Presence) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores of texts that have a letter."""
        value = self.landmarks.kernel([prepared(t) for t in texts], look, self.weights)
        return np.array(self.langs, object)[value.argmax(1)], np.clip((1 + value.max(1)) / 2, 0, 1)


def predictions(model: Model | None, columns: Iterator[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each list of texts: which have a letter, their languages, and their scores."""
    look = None
    for texts in columns:
        lettered = np.fromiter((bool(t and LETTER.search(t)) for t in texts), bool, len(texts))
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if model and lettered.any():
            look = look or Presence(model.landmarks.widths, model.landmarks.grams)
            langs[lettered], scores[lettered] = model.predict([t for t, x in zip(texts, lettered, strict=True) if x], look)
        yield lettered, langs, scores


def accepted(docs: DataFrame, settings: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, with the predicted language where ``lang`` is null.

    Null texts and texts without a letter are rejected. Where there is no labelled row to learn from, ``lang`` stays.
    """
    model = model or scoped_model(docs, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()
        texts = (waiting.append(batch) or batch.column(text).to_pylist() for batch in bounded(batches, text))
        for lettered, langs, _ in predictions(shared.value, texts):
            batch = waiting.popleft()
            if shared.value:
                own = [a or b for a, b in zip(batch.column(lang).to_pylist(), langs, strict=True)]
                batch = batch.set_column(lang, batch.schema.field(lang), pa.array(own, batch.schema.field(lang).type))
            yield batch.filter(pa.array(lettered))

    return docs.mapInArrow(run, docs.schema)


def scoped_model(docs: DataFrame, settings: Settings) -> Model | None:
    with scratch(docs.sparkSession):
        return learn(docs, settings)


def identify(docs: DataFrame, settings: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter get ``und`` and score 0; so does every text when no labelled
    row is there to learn from. The score is the winning regression value, moved from -1..1 to 0..1.
    Ties go to the alphabetically first language. Null ids count as not held out and aren't learnt
    from. An empty table gives no row. Other columns, and lang itself, don't enter a prediction.
    """
    model = model or scoped_model(docs, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()
        texts = (waiting.append(batch) or batch.column(2).to_pylist() for batch in bounded(batches, 2))
        for _, langs, scores in predictions(shared.value, texts):
            batch = waiting.popleft()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    held = F.coalesce(fold_of(F.col("doc_id"), settings.parts) == settings.held, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
