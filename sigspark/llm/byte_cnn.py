"""A quality classifier: a byte-level convolutional network in numpy.

Filters over a few bytes are learnt from labelled texts. A document is covered by overlapping chunks;
in each chunk every filter keeps its largest response; the mean and the largest of the chunks'
responses are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, hashed_sample, read_table, text_bytes

#: Positions over which responses are reduced first; chunks begin and end at multiples of it.
BLOCK = 64


@dataclass(frozen=True)
class Settings:
    """At most ``sample`` labelled ids are learnt from, the first in an order by hash, and always from
    their whole texts: fewer where texts are long, as none is added once they have ``sample`` times
    ``stretch`` bytes. Chunks are ``chunk`` blocks long and begin ``step`` blocks apart.
    """

    sample: int = 4000
    stretch: int = 8192
    filters: int = 16
    width: int = 5
    chunk: int = 8
    step: int = 7
    epochs: int = 12
    batch: int = 32
    rate: float = 0.02
    decay: float = 1e-4
    parts: int = 5
    held: int = 0
    threshold: float = 0.3
    seed: int = 3


def laid_out(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each filled up with zeros to whole blocks, and the blocks of each.

    At least ``width`` - 1 zeros end each text and stand before the first, so that no filter sees two
    texts: a response belongs to the last byte that it sees.
    """
    counts = np.array([-(-(len(t) + width - 1) // BLOCK) or 1 for t in texts], np.int64)
    raw = b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, counts.tolist(), strict=True))
    return np.frombuffer(bytes(width - 1) + raw, np.uint8), counts


def chunks_of(counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block (exclusive) of each chunk, and the chunks of each text."""
    each = np.maximum(1, -(-(counts - (s.chunk - s.step)) // s.step))
    text = np.repeat(np.arange(len(counts)), each)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    first = begins[text] + place * s.step
    return first, np.minimum(first + s.chunk, begins[text] + counts[text]), each


class Network:
    def __init__(self, s: Settings):
        self.s = s
        rng = np.random.default_rng(s.seed)
        self.filters = rng.normal(0, 0.3, (s.width, 256, s.filters)).astype(np.float32)
        self.shift = np.zeros(s.filters, np.float32)
        self.out = rng.normal(0, 0.1, 2 * s.filters + 1).astype(np.float32)

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """Block x filter: the largest response in each block."""
        n = len(raw) - self.s.width + 1
        h = self.filters[0].take(raw[:n], 0)
        for j in range(1, self.s.width):
            h += self.filters[j].take(raw[j : n + j], 0)
        return h.reshape(n // BLOCK, BLOCK, -1).max(1)

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunk x filter responses, the chunks of each text, the array of bytes, and each chunk's first block."""
        raw, counts = laid_out(texts, self.s.width)
        step = BLOCK * 2048
        blocks = np.concatenate([self.responses(raw[i : i + step + self.s.width - 1]) for i in range(0, len(raw) - self.s.width + 1, step)])
        first, last, each = chunks_of(counts, self.s)
        best = blocks[first]
        for k in range(1, self.s.chunk):
            best = np.maximum(best, blocks[np.minimum(first + k, last - 1)])
        return np.maximum(best + self.shift, 0), each, raw, first

    def features(self, best: np.ndarray, each: np.ndarray) -> np.ndarray:
        at = np.cumsum(each) - each
        return np.concatenate([np.add.reduceat(best, at) / each[:, None], np.maximum.reduceat(best, at)], 1)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        best, each, _, _ = self.pooled(texts)
        z = self.features(best, each) @ self.out[:-1] + self.out[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60).astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
        """Of filters, shifts and output weights, for the mean logistic loss."""
        s = self.s
        best, each, raw, first = self.pooled(texts)
        x = self.features(best, each)
        p = 1 / (1 + np.exp(-np.clip(x @ self.out[:-1] + self.out[-1], -60, 60)))
        d = ((p - y) / len(y)).astype(np.float32)
        out = np.concatenate([d @ x, [d.sum()]]) + s.decay * self.out
        f, text = s.filters, np.repeat(np.arange(len(each)), each)
        top = best == x[text, f:]
        top = top / np.maximum(1, np.add.reduceat(top.astype(np.float32), np.cumsum(each) - each))[text]
        back = d[text, None] * (self.out[:f] / each[text, None] + self.out[f:-1] * top) * (best > 0)
        filters = s.decay * self.filters
        span = np.arange(s.chunk * BLOCK)
        for k in range(0, len(first), 512):  # where in its chunk each filter responds most
            base = first[k : k + 512] * BLOCK
            at = np.minimum(base[:, None] + span, len(raw) - s.width)
            h = sum(self.filters[j].take(raw[at + j], 0) for j in range(s.width))
            place = h.argmax(1)
            rows, columns = np.nonzero(back[k : k + 512])
            where = base[rows] + place[rows, columns]
            where = np.minimum(where, len(raw) - s.width)
            for j in range(s.width):
                np.add.at(filters[j], (raw[where + j], columns), back[k : k + 512][rows, columns])
        return [filters, back.sum(0), out.astype(np.float32)]

    def fit(self, texts: list[bytes], y: np.ndarray) -> Network:
        """Adam over batches in a fixed random order, with a falling rate."""
        s, rng = self.s, np.random.default_rng(self.s.seed + 1)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.filters, self.shift, self.out)]
        total, t = max(1, s.epochs * -(-len(texts) // s.batch)), 0
        rate = np.clip(y.mean(), 0.01, 0.99)
        self.out[-1] = np.log(rate / (1 - rate))
        for _ in range(s.epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), s.batch):
                part = order[k : k + s.batch]
                step = s.rate * (1 - t / total)
                t += 1
                for p, g, m in zip((self.filters, self.shift, self.out), self.gradients([texts[i] for i in part], y[part]), state, strict=True):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    p -= step * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, s: Settings) -> Network | float:
    """Fit on whole texts of a bounded sample of labelled ids. Several labels of an id count as their mean; null ones don't count.

    Different texts of an id are all learnt from; an id whose texts don't fit in what is left of the bytes is passed over.
    Without labels of both kinds there is nothing to fit: the labels' mean, or 0.5 without any, stands for all.
    """
    known = labels.filter("quality is not null and doc_id is not null").filter(fold_of(F.col("doc_id"), s.parts) != s.held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    chosen = hashed_sample(known, s.sample, "doc_id")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    each = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", F.xxhash64("raw").alias("digest")).agg(F.max(F.length("raw")).alias("n"))
    sizes = each.groupBy(F.xxhash64("doc_id").alias("place"), "doc_id", "quality").agg(F.sum("n").alias("n")).collect()
    taken, room = [], s.sample * s.stretch
    for r in sorted(sizes):
        if r.n <= room:
            taken.append((r.doc_id, r.quality))
            room -= r.n
    if not taken:
        return 0.5
    rows = texts.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, quality double")), "doc_id").dropDuplicates(["doc_id", "raw"]).collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.raw)))
    if len({r.quality >= 0.5 for r in rows}) < 2:
        return float(np.mean([q for _, q in taken]))
    return Network(s).fit([bytes(r.raw) for r in rows], np.array([r.quality for r in rows], np.float32))


def runs(texts: list[bytes], size: int = 1 << 18) -> Iterator[list[bytes]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) + BLOCK
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def score_quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only ids whose crc32(doc_id as text) mod ``parts`` isn't ``held`` are learnt from. Null texts count
    as empty and are scored as well. Without labels of both kinds every score is the labels' mean (0.5 without any). Null ids aren't held
    out. Repeated rows are scored one by one; an empty table gives no row; no other column of
    ``docs`` is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            texts = list(text_bytes(batch.column(2)))
            score = np.concatenate([np.empty(0), *(np.full(len(part), network) if isinstance(network, float) else network.predict(part) for part in runs(texts))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= s.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    held = F.coalesce(fold_of(F.col("doc_id"), s.parts) == s.held, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
