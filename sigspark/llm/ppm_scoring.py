"""Language-model scores by prediction by partial matching over bytes.

A trie of byte contexts up to ``order`` bytes is counted over all training texts. A symbol's code
length is that of the longest context that has seen it; each longer context costs its escape, and
symbols seen there are excluded below. The counts are those of a pretrained model, so a context's
symbols are among its suffix's, and the exclusions of a path are sums that can be kept per context.
Escapes are those of method D. Every context counts, however rare: tasks look up the values of the most
frequent symbols in context; what a text has besides meets its part of the trie in a shuffle.
A unigram model of words, with its counts kept apart, is the base that scores are read against.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold_of, materialise, read_table, scoped, ship_arrays, text_bytes

#: Bytes that UTF-8 never has: before a text's first byte, and its end, which is coded as a symbol.
PAD, END = 0xFE, 0xFF
#: Symbols of the order below 0: all bytes but PAD.
SYMBOLS = 255
#: Contexts that agree in so many last bytes are in one part of the trie. Shorter ones (2^24 at most) are in all.
SUFFIX = 3
#: Symbols in context in a part of the trie, on average, and the least number of parts.
PART, PARTS = 1 << 17, 32


@dataclass(frozen=True)
class Settings:
    """The values of the most frequent symbols in context, 1 / least_gram at most, and words of at least
    ``least_word`` of all training tokens (1 / least_word at most) are looked up in the tasks; the
    others meet their counts in a shuffle. Neither changes a score.
    """

    order: int = 6
    parts: int = 7
    held: int = 2
    least_gram: float = 2.0**-21
    least_word: float = 1 / 200_000


def framed(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with their pads and ends in one array, and where each begins."""
    pad, end = bytes([PAD]) * order, bytes([END])
    parts = [pad + t.lower() + end for t in texts]
    starts = np.cumsum([0, *[len(p) for p in parts[:-1]]]) if parts else np.empty(0, np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def grams_of(raw: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, packed; for bytes from place ``order`` on."""
    code = np.zeros(len(raw) - order, np.int64)
    for i in range(order + 1):
        code <<= 8
        code |= raw[i : len(raw) - order + i]
    return code


def runs(texts: Iterator[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) + 8
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(n, at)


def counted(docs: DataFrame, settings: Settings) -> DataFrame:
    """(word, gram, n): counts of words, of ends (the empty word) and of bytes in context, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def rows(word: pa.Array, gram: pa.Array, n: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([word, gram, n], names=["word", "gram", "n"])

        def words_out() -> pa.RecordBatch:
            out = rows(pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64()))
            words.clear()
            return out

        def grams_out() -> pa.RecordBatch:
            key, n = summed(keys, counts)
            keys.clear(), counts.clear()
            return rows(pa.nulls(len(key), pa.binary()), pa.array(key), pa.array(n))

        for batch in batches:
            for part in runs(text_bytes(batch.column(0))):
                raw, _ = framed(part, settings.order)
                code = grams_of(raw, settings.order)
                code.sort()
                at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                n = np.diff(np.concatenate([at, [len(code)]]))
                code = code[at]
                real = (code & 255) != PAD
                keys.append(code[real])
                counts.append(n[real])
                if len(keys) > 1 and sum(map(len, keys)) > 2_000_000:
                    key, n = summed(keys, counts)
                    keys[:], counts[:] = [key], [n]
                    if len(key) > 1_500_000:
                        yield grams_out()
                for t in part:
                    words.update(t.lower().split())
                words[b""] += len(part)
                if len(words) > 200_000:
                    yield words_out()
        if words:
            yield words_out()
        if keys:
            yield grams_out()

    return docs.select("text").mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Trie:
    """The context trie in sorted arrays, from (order, key, count); a key is context and symbol."""

    def __init__(self, order: int, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.order = order
        self.keys, self.logs, self.contexts, self.first, self.passed, self.below = [], [], [], [], [], []
        weights, sizes, escapes = [], [], []
        for k, (keys, counts) in enumerate(tables):
            w = counts - 0.5  # escape method D: a half of each symbol's first sight goes to the escape
            context = keys >> 8
            at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.empty(0, np.int64)
            contexts = context[at]
            group = lambda x, at=at: np.add.reduceat(x, at) if len(at) else np.empty(0)
            size = group(counts)
            escape = size - group(w)
            self.keys.append(keys)
            self.logs.append(np.log10(w))
            self.contexts.append(contexts)
            self.first.append((np.log10(size), np.log10(escape)))
            if k:
                # After an escape to the context's suffix, symbols seen in the context are excluded there.
                up, _ = find(self.keys[k - 1], keys & ((1 << (8 * k)) - 1))
                parent, _ = find(self.contexts[k - 1], contexts & ((1 << (8 * (k - 1))) - 1))
                left = sizes[k - 1][parent] - group(weights[k - 1][up]) if len(at) else np.empty(0)
                self.below.append(np.log10(left))
                step = np.log10(escapes[k - 1][parent]) - self.below[k]
                self.passed.append(step + (self.passed[k - 1][parent] if k > 1 else 0.0))
            else:
                self.below.append(np.zeros(len(contexts)))
                self.passed.append(np.zeros(len(contexts)))
            weights.append(w)
            sizes.append(size)
            escapes.append(escape)
        seen = len(self.keys[0])
        self.rest = -math.log10(SYMBOLS - seen) if seen < SYMBOLS else 0.0

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each packed byte after its context."""
        n = len(grams)
        start = np.full(n, -1)  # the longest context that the trie has
        level = np.full(n, -1)  # the longest that has seen the symbol
        value = np.zeros(n)
        escape, passed = np.zeros(n), np.zeros(n)
        place: list[np.ndarray] = []
        for k in range(self.order, -1, -1):
            at, there = find(self.contexts[k], (grams >> 8) & ((1 << (8 * k)) - 1))
            place.insert(0, at)
            new = there & (start < 0)
            start[new] = k
            escape[new] = self.first[k][1][at[new]] - self.first[k][0][at[new]]
            passed[new] = self.passed[k][at[new]]
        for k in range(self.order, -1, -1):
            todo = np.flatnonzero((level < 0) & (start >= k))
            at, there = find(self.keys[k], grams[todo] & ((1 << (8 * (k + 1))) - 1))
            hit = todo[there]
            level[hit] = k
            own = self.logs[k][at[there]]
            top = start[hit] == k
            value[hit[top]] = own[top] - self.first[k][0][place[k][hit[top]]]
            low = hit[~top]
            if len(low):
                over = place[k + 1][low]
                value[low] = escape[low] + passed[low] - self.passed[k + 1][over] + own[~top] - self.below[k + 1][over]
        none = level < 0
        value[none] = escape[none] + passed[none] + self.rest
        return value


class Settled:
    """Values of packed bytes in a direct-mapped table; what finds its slot taken is in sorted arrays."""

    FIELDS = ("key", "value", "more", "more_value")

    def __init__(self, order: int, kinds: int, entries: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """From batches of keys, counts and values, ``kinds`` in all."""
        self.order, slots = order, 1 << max(10, kinds.bit_length())
        self.key, self.value = np.full(slots, -1, np.int64), np.zeros(slots)
        held = np.zeros(slots, np.float32)
        more, more_value = [np.empty(0, np.int64)], [np.empty(0)]
        for keys, counts, values in entries:
            by = np.argsort(counts, kind="stable")  # the more frequent entry holds a slot
            keys, counts, values = keys[by], counts[by].astype(np.float32), values[by]
            slot = self.slots(keys)
            won = np.flatnonzero(counts > held[slot])
            out = np.unique(slot[won])
            out = out[self.key[out] >= 0]
            more.append(self.key[out])
            more_value.append(self.value[out])
            self.key[slot[won]], self.value[slot[won]], held[slot[won]] = keys[won], values[won], counts[won]
            lost = np.flatnonzero(self.key[slot] != keys)
            more.append(keys[lost])
            more_value.append(values[lost])
        self.more = np.concatenate(more)
        by = np.argsort(self.more)
        self.more, self.more_value = self.more[by], np.concatenate(more_value)[by]

    @classmethod
    def of(cls, order: int, arrays: dict[str, np.ndarray]) -> Settled:
        """From its arrays, which may be memory-mapped."""
        out = cls.__new__(cls)
        out.__dict__.update(arrays, order=order)
        return out

    def slots(self, grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.key).bit_length())).view(np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the probability of each text's known bytes and its end; the text and the code of each other one."""
        if not texts:
            return np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        raw, starts = framed(texts, self.order)
        grams = grams_of(raw, self.order)
        slot = self.slots(grams)
        value = self.value[slot]
        pad = raw[self.order :] == PAD
        miss = np.flatnonzero((self.key[slot] != grams) & ~pad)
        value[pad] = 0
        at, there = find(self.more, grams[miss])
        value[miss[there]] = self.more_value[at[there]]
        miss = miss[~there]
        value[miss] = 0
        return np.add.reduceat(value, starts), np.searchsorted(starts, miss, "right") - 1, grams[miss]


class Scorer:
    """The whole model in one process."""

    def __init__(self, order: int, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.trie = Trie(order, tables)
        self.settled = Settled(order, len(tables[-1][0]), [(*tables[-1], self.trie.score(tables[-1][0]))])

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text with its end."""
        score, text, grams = self.settled(texts)
        return score + np.bincount(text, self.trie.score(grams), len(texts))


def settled_values(grams: DataFrame, settings: Settings) -> tuple[Settled, int]:
    """The most frequent symbols in context with their values, and how many there are in all."""
    band = F.floor(F.ln("n") * 64)
    room, least, kinds, chosen = int(1 / settings.least_gram), math.inf, 0, 0
    for b, n in sorted(grams.groupBy(band).count().collect(), reverse=True):
        kinds += n
        least, chosen = (b, kinds) if kinds <= room else (least, chosen)
    size = F.sum("n").over(Window.partitionBy(F.shiftright("gram", 8)))
    value = F.log10(F.col("n") - F.lit(0.5)) - F.log10("size")
    kept = grams.withColumn("size", size).filter(band >= F.lit(float(least))).select("gram", F.col("n").cast("float").alias("n"), value.alias("value")).toArrow()
    return Settled(settings.order, chosen, ([c.to_numpy() for c in batch.columns] for batch in kept.to_batches())), kinds


def dealt(grams: np.ndarray, other: np.ndarray, order: int, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Packed bytes and what goes with them, by the part of the trie that has their contexts."""
    part = ((((grams >> 8) & ((1 << (8 * min(SUFFIX, order))) - 1)) * 0x9E3779B1 >> 8) & 0xFFFFFF) % parts
    by = np.argsort(part, kind="stable")
    part = part[by]
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)] if len(part) else []
    for a, z in pairwise(cuts):
        yield int(part[a]), grams[by[a:z]].tobytes(), other[by[a:z]].tobytes()


DEALT = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("grams", pa.binary()), ("other", pa.binary())])


def unsettled(grams: DataFrame, asked: DataFrame, parts: int, settings: Settings) -> DataFrame:
    """(row, score): sums of the values of ``asked`` (part, row, grams, other: the row of each gram, from ``row`` on).

    Each part of the trie is built where its contexts are asked for. Contexts shorter than SUFFIX are
    sums of few kinds and are broadcast.
    """
    order, low = settings.order, min(SUFFIX, settings.order)
    short = grams.groupBy(F.col("gram").bitwiseAND((1 << (8 * low)) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    shared = grams.sparkSession.sparkContext.broadcast((short.column("key").to_numpy(), short.column("n").to_numpy().astype(np.float64)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            rows = list(dealt(np.concatenate(keys), np.concatenate(counts), order, parts))
            keys.clear(), counts.clear()
            return pa.RecordBatch.from_pylist([{"part": p, "row": None, "grams": g, "other": n} for p, g, n in rows], DEALT)

        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            counts.append(batch.column(1).to_numpy())
            if sum(map(len, keys)) > 1_000_000:
                yield out()
        if sum(map(len, keys)):
            yield out()

    def tables(keys: list[bytes], counts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        own = np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(counts), np.int64).astype(np.float64)
        every = [(shared.value if k < low else own) for k in range(order + 1)]
        return [summed([key & ((1 << (8 * (k + 1))) - 1)], [n]) if len(key) else (key, n) for k, (key, n) in enumerate(every)]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trie = None, None
        keys, counts, rows, codes = [], [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal trie
            if codes:
                trie = trie or Trie(order, tables(keys, counts))
                each, back = np.unique(np.concatenate(codes), return_inverse=True)
                row, at = np.unique(np.concatenate(rows), return_inverse=True)
                codes.clear(), rows.clear()
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.bincount(at, trie.score(each)[back]))], names=["row", "score"])

        for batch in batches:
            for p, row, grams, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    yield from out()
                    part, trie = p, None
                    keys.clear(), counts.clear()
                if row is None:
                    keys.append(grams)
                    counts.append(other)
                else:
                    codes.append(np.frombuffer(grams, np.int64))
                    rows.append(np.frombuffer(other, np.int32).astype(np.int64) + row)
                    if sum(map(len, codes)) > 500_000:
                        yield from out()
        yield from out()

    counted = grams.select("gram", "n").mapInArrow(deal, "part int, row long, grams binary, other binary")
    both = counted.union(asked).repartition("part").sortWithinPartitions("part", F.col("row").asc_nulls_first())
    return both.mapInArrow(answer, "row long, score double")


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word: binary, n: long>>, asked array<struct<part: int, grams: binary, other: binary>>"
TAIL = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
ASKED = pa.list_(pa.struct([("part", pa.int32()), ("grams", pa.binary()), ("other", pa.binary())]))


@scoped
def ppm_scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod ``parts`` isn't ``held``; null ids are neither
    learnt from nor held out. A-Z is lower-cased; null counts as an empty text, which has one token,
    its end. Without training rows all bytes are equally likely and the base is 0. Repeated rows
    count and are scored one by one; an empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    fold = fold_of(F.col("doc_id"), settings.parts)
    counts = materialise(counted(docs.filter(fold != settings.held), settings))
    words = counts.filter("word is not null").select("word", F.col("n").alias("c"))
    total, distinct = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    common = words.filter(F.col("c") >= settings.least_word * total).toArrow()
    size = math.log10(total + distinct + 1)
    known = dict(zip(common.column("word").to_pylist(), (np.log10(common.column("c").to_numpy() + 1.0) - size).tolist(), strict=True))
    end = known.get(b"", -size)  # ends are as many as texts; they are rare only among very long ones
    if b"" not in known and total:
        row = words.filter(F.col("word") == F.lit(b"")).first()
        end = math.log10((row.c if row else 0) + 1) - size
    grams = counts.filter("gram is not null").select("gram", "n")
    settled, kinds = settled_values(grams, settings)
    parts = max(PARTS, kinds // PART)
    model = ship_arrays(spark, {f: getattr(settled, f) for f in Settled.FIELDS})
    del settled
    lookup = spark.sparkContext.broadcast(known)
    ends = int(total > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, get = Settled.of(settings.order, model()), lookup.value.get
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for part in runs(text_bytes(batch.column(2)), 1 << 18):
                n = len(part)
                numbers, tails = np.zeros((n, 2), np.int64), []
                base = np.full(n, end)
                for i, text in enumerate(part):
                    tokens = text.lower().split()
                    values = list(map(get, tokens))
                    own = [v for v in values if v is not None]
                    base[i] += math.fsum(own)
                    numbers[i] = len(tokens) + 1, len(own) + ends
                    tails.append([(w, k) for w, k in Counter(w for w, v in zip(tokens, values, strict=True) if v is None).items()] if len(own) < len(tokens) else [])
                score, text, codes = scorer(part)
                asked = [dict(zip(("part", "grams", "other"), d, strict=True)) for d in dealt(codes, text.astype(np.int32), settings.order, parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(numbers[:, 0].copy()),
                     pa.array(numbers[:, 1].copy()), pa.array(base), pa.array(score), pa.array(tails, TAIL), pa.array([asked, *[[]] * (n - 1)], ASKED)],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "asked"],
                )
                row, at = row + n, at + n

    held = F.coalesce(fold == settings.held, F.lit(False))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, SCORED)
    scored = materialise(scored)

    rare = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    c: Column = F.coalesce("c", F.lit(0))
    words_more = (
        rare.join(words.filter(F.col("c") < settings.least_word * total).hint("shuffle_hash"), "word", "left")
        .select("row", (F.col("n") * (F.log10(c + F.lit(1.0)) - F.lit(size))).alias("base"), F.when(c > 0, F.col("n")).otherwise(0).alias("known"), F.lit(0.0).alias("score"))
    )
    asked = scored.select("row", F.explode("asked").alias("a")).select("a.part", "row", "a.grams", "a.other")
    grams_more = unsettled(grams, asked, parts, settings).select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), "score")
    more = words_more.union(grams_more).groupBy("row").agg(F.sum("base").alias("more"), F.sum("known").alias("more_known"), F.sum("score").alias("more_score"))
    return scored.drop("tail", "asked").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op2_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(read_table(spark, sf_dir, "documents"))
