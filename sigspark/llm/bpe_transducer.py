"""Byte-level BPE with a lexicon compiled into a minimal acyclic transducer.

Frequent words of the corpus and the ids of their encoding become an automaton that shares suffixes;
arcs carry partial word numbers whose sum along a path is the place of the word's ids. Tasks
memory-map it. Words that it doesn't have are merged exactly, by the ranks of the vocabulary.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialise, read_table, scratch, ship_arrays

# Fixed value: the split that byte-level BPE makes before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: a space before what isn't one, where that split always cuts.
SAFE = re.compile(r" (?=\S)")
SPACED = re.compile(r" \s")
#: The lexicon has the most frequent words of the corpus, this many at most (those of equal count go together).
MOST_WORDS = 400_000


def printable_bytes() -> dict[str, int]:
    """Characters of the vocabulary file, and the bytes that they stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def without(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Each row without one of its places."""
    keep = np.ones(rows.shape, bool)
    keep[np.arange(len(rows)), places] = False
    return rows[keep].reshape(len(rows), rows.shape[1] - 1)


class Vocabulary:
    """Ids, bytes and merge ranks of a byte-level BPE file of the tokenizers library."""

    def __init__(self, content: str):
        data = json.loads(content)
        back = printable_bytes()
        to_bytes = lambda token: bytes(back[c] for c in token)
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.tokens[i] = to_bytes(token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.single = [ids[c] for c, _ in sorted(back.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        pairs = np.array([a << 32 | b for a, b in self.merges], np.int64)
        self.made = np.array([new for _, new in self.merges.values()], np.int64)  # by rank
        self.pair_ranks = np.argsort(pairs)
        self.pairs = pairs[self.pair_ranks]
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens, in order."""
        return self.words.findall(text)

    def chunks(self, text: str) -> list[str]:
        """Stretches of a text whose words don't depend on one another: with the space before it left out,
        or, for those that begin the text or follow a special token, with a space more. Special tokens
        are stretches of the second kind."""
        out: list[str] = []
        parts = self.cut.split(text) if self.cut is not None and any(s in text for s in self.special) else [text]
        for part in filter(None, parts):
            own = [part] if part in self.special else SAFE.split(part) if SPACED.search(part) else part.split(" ")
            own[0] = " " + own[0]
            out += own
        return out

    def special_id(self, chunk: str) -> int | None:
        return self.special.get(chunk[1:]) if chunk.startswith(" ") else None

    def chunk_pieces(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of stretches, one stretch after the other, and the number of words up to the end of each."""
        heads = [self.words.findall(c[1:]) for c in chunks if c.startswith(" ")]
        tails = self.words.findall("".join(" " + c for c in chunks if not c.startswith(" ")))
        first = np.fromiter((c.startswith(" ") for c in chunks), bool, len(chunks))
        ends = np.zeros(len(chunks), np.int64)
        ends[first] = np.cumsum([len(h) for h in heads])
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))[~first] + 1
        ends[~first] = np.searchsorted(np.cumsum(np.fromiter(map(len, tails), np.int64, len(tails))), np.cumsum(sizes)) + 1
        by = np.argsort(~first, kind="stable")
        chunks[:] = [chunks[i] for i in by.tolist()]
        ends[~first] += sum(map(len, heads))
        return [*chain(*heads), *tails], ends[by]

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of lowest rank is merged first, the leftmost of equals."""
        ids = [self.single[b] for b in word]
        if len(ids) > 48:
            return self.merge_long(ids)
        get, none = self.merges.get, (1 << 30, 0)
        found = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The same for many words, as little-endian unsigned 32-bit integers. Words of one length step
        together: in each step every word that still has a pair to merge loses one place."""
        out = [b""] * len(words)
        by = defaultdict(list)
        for i, w in enumerate(words):
            by[len(w)].append(i)
        single = np.array(self.single, np.int64)
        for length, places in by.items():
            if length > 48:
                for i in places:
                    out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
                continue
            at = np.array(places)
            ids = single[np.frombuffer(b"".join([words[i] for i in places]), np.uint8).reshape(len(places), length)]
            ranks = self.ranks(ids[:, :-1], ids[:, 1:])
            while True:
                best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(at), np.int64)
                more = ranks[np.arange(len(at)), best] < len(self.made) if ranks.shape[1] else np.zeros(len(at), bool)
                raw, step = ids[~more].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, i in enumerate(at[~more].tolist()):
                    out[i] = raw[k * step : (k + 1) * step]
                if not more.any():
                    break
                at, ids, ranks, best = at[more], ids[more], ranks[more], best[more]
                row = np.arange(len(at))
                ids[row, best] = self.made[ranks[row, best]]
                ids = without(ids, best + 1)
                ranks = without(ranks, best)
                left, right = row[best > 0], row[best < ranks.shape[1]]
                b = best[left]
                ranks[left, b - 1] = self.ranks(ids[left, b - 1], ids[left, b])
                b = best[right]
                ranks[right, b] = self.ranks(ids[right, b], ids[right, b + 1])
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; those that don't merge have the number of all pairs."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], len(self.made)) if len(self.pairs) else np.zeros(key.shape, np.int64)

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for words of any length."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.merges.get((a, b)))]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (m := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (*m, i, ids[i], ids[j]))

        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in ids if x >= 0]


class Transducer:
    """A minimal acyclic automaton over bytes, in flat arrays that can be memory-mapped."""

    FIELDS = ("arc_key", "arc_target", "arc_skip", "final", "id_start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, entries: Iterable[tuple[bytes, list[int]]]) -> Transducer:
        """Build from distinct words: sorted insertion, each finished state replaced by an equal one.

        A state is finished after all that it leads to, so that words below it are counted at once; only
        the states of the last word's path are unfinished.
        """
        entries = sorted(entries)
        register: dict[bytes, int] = {}
        starts, labels, targets, skips = array("q", [0]), array("q"), array("q"), array("q")
        final, below = array("q"), array("q")
        path: list[list] = [[0, array("q"), array("q")]]  # final, labels, targets
        last = b""

        def finish() -> int:
            ends, own, to = path.pop()
            key = bytes([ends]) + own.tobytes() + to.tobytes()
            state = register.setdefault(key, len(final))
            if state == len(final):
                n = ends
                for label, target in zip(own, to, strict=True):
                    labels.append(label)
                    targets.append(target)
                    skips.append(n)
                    n += below[target]
                starts.append(len(labels))
                final.append(ends)
                below.append(n)
            return state

        def settle(depth: int) -> None:
            while len(path) - 1 > depth:
                label = last[len(path) - 2]
                state = finish()
                path[-1][1].append(label)
                path[-1][2].append(state)

        for word, _ in entries:
            k = len(os.path.commonprefix([word, last]))
            settle(k)
            path += [[0, array("q"), array("q")] for _ in range(len(word) - k)]
            path[-1][0] = 1
            last = word
        settle(0)
        root = finish()

        whole = lambda x: np.array(x, np.int64)
        state = root - np.repeat(np.arange(len(final)), np.diff(whole(starts)))  # the root is number 0
        keys = state << 8 | whole(labels)
        at = np.argsort(keys, kind="stable")
        return cls({
            "arc_key": keys[at], "arc_target": root - whole(targets)[at], "arc_skip": whole(skips)[at], "final": whole(final)[::-1].copy(),
            "id_start": np.concatenate([[0], np.cumsum([len(ids) for _, ids in entries], dtype=np.int64)]).astype(np.int64),
            "ids": np.fromiter((i for _, ids in entries for i in ids), np.int64),
        })

    def places(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words in the lexicon, -1 for others; all words step together."""
        lengths = np.array([len(w) for w in words], np.int64)
        by = np.argsort(-lengths, kind="stable")
        lengths = lengths[by]
        starts = np.cumsum([0, *lengths[:-1].tolist()]) if len(by) else np.empty(0, np.int64)
        raw = np.frombuffer(b"".join([words[i] for i in by]), np.uint8)
        state, place = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        live, step = np.arange(len(by)), 0
        while len(self.arc_key):
            live = live[lengths[live] > step]
            if not len(live):
                break
            key = state[live] << 8 | raw[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[arc] == key
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            place[live] += self.arc_skip[arc]
            state[live] = self.arc_target[arc]
            step += 1
        out = np.full(len(by), -1, np.int64)
        good = (state >= 0) & (lengths > 0)
        good[good] = self.final[state[good]] == 1
        out[by[good]] = place[good]
        return out


class Recent(dict):
    """A mapping that keeps what was asked for lately: when it is full, what wasn't asked for since it
    was last full is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def lacking(self, keys: set) -> list:
        """Those of the keys that are nowhere; the others are here from now on."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        new = keys - self.keys()
        back = new & self.older.keys()
        self.update((k, self.older[k]) for k in back)
        return list(new - back)


class Encoder:
    """Encodes texts; ids of stretches and of merged words met lately are kept."""

    MOST, LONGEST = 150_000, 64

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.v, self.lexicon = vocabulary, lexicon
        self.known, self.merged = Recent(self.MOST), Recent(self.MOST)

    def words(self, new: set[str]) -> dict[str, bytes]:
        """Ids of distinct words: those in the lexicon are read from it, others merged."""
        names = list(new)
        place = self.lexicon.places([w.encode() for w in names])
        hit = np.flatnonzero(place >= 0)
        out = {}
        if len(hit):
            start, end = self.lexicon.id_start[place[hit]], self.lexicon.id_start[place[hit] + 1]
            sizes = end - start
            last = np.cumsum(sizes)
            at = np.repeat(start - last + sizes, sizes) + np.arange(last[-1])
            raw = self.lexicon.ids[at].astype("<u4").tobytes()
            stops = (last * 4).tolist()
            out = {names[i]: raw[a:z] for i, a, z in zip(hit.tolist(), [0, *stops], stops, strict=False)}
        others = {names[i] for i in np.flatnonzero(place < 0).tolist()}
        new = self.merged.lacking(others)
        self.merged.update(zip(new, self.v.merge_many([w.encode() for w in new]), strict=True))
        for word in others:
            out[word] = self.merged[word]
            if len(word) > self.LONGEST:
                del self.merged[word]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.v.chunks(t) for t in texts]
        new = self.known.lacking(set().union(*cut))
        special = {c: i for c in new if (i := self.v.special_id(c)) is not None}
        self.known.update((c, np.array([i], "<u4").tobytes()) for c, i in special.items())
        chunks = [c for c in new if c not in special]
        pieces, ends = self.v.chunk_pieces(chunks)
        parts = list(map(self.words(set(pieces)).__getitem__, pieces))
        raw, stops = b"".join(parts), np.cumsum([0, *map(len, parts)])[ends].tolist()
        self.known.update((c, raw[a:z]) for c, a, z in zip(chunks, [0, *stops], stops, strict=False))
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for chunk in new:
            if len(chunk) > self.LONGEST:
                del self.known[chunk]
        return out

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.v.tokens.__getitem__, numbers)).decode("utf-8", "replace")


def slices(texts: list[str | None], size: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters; null counts as empty."""
    part, n = [], 0
    for text in texts:
        part.append(text or "")
        n += len(part[-1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def word_counts(docs: DataFrame, content: str) -> DataFrame:
    """(word, n): words of the corpus, counted over whole texts. Stretches are counted first, and cut into words once each."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = Vocabulary(shared.value), Counter()

        def flush() -> pa.RecordBatch:
            words: dict[str, int] = defaultdict(int)
            chunks = [c for c in counts if vocabulary.special_id(c) is None]
            pieces, ends = vocabulary.chunk_pieces(chunks)
            times = np.repeat([counts[c] for c in chunks], np.diff(ends, prepend=0)).tolist()
            for word, n in zip(pieces, times, strict=True):
                words[word] += n
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w.encode() for w in words], pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"]
            )

        size = 0
        for batch in bounded(batches, 0):
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.chunks(text or ""))
                size += len(text or "")
                if len(counts) > 400_000 or size > 1 << 26:
                    yield flush()
                    size = 0
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_entries(docs: DataFrame, content: str, most: int) -> list[tuple[bytes, list[int]]]:
    """The most frequent words that come twice at least, and their ids, which tasks merge."""
    words = materialise(word_counts(docs, content))  # removed with the scope of the caller
    band = F.floor(F.ln("n") * 64)
    kinds, least = 0, math.inf
    for b, n in sorted(words.filter("n > 1").groupBy(band).count().collect(), reverse=True):
        kinds += n
        least = b if kinds <= most else least
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vocabulary.merge_many(batch.column(0).to_pylist()), pa.binary())], names=["word", "ids"])

    chosen = words.filter((F.col("n") > 1) & (band >= F.lit(float(least)))).select("word").mapInArrow(merge, "word binary, ids binary").toArrow()
    return [(w, np.frombuffer(i, "<u4").tolist()) for w, i in zip(chosen.column("word").to_pylist(), chosen.column("ids").to_pylist(), strict=True)]


def encode_documents(docs: DataFrame, vocabulary_path: str, *, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian 32-bit), decoded.

    Null counts as empty: no ids and an empty text. Special tokens written in a text become their ids,
    as the tokenizers library does. Repeated rows and null ids are encoded row by row; an empty table
    gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    with scratch(spark):
        lexicon = Transducer.compile(frequent_entries(docs, content, most_words))
    load = ship_arrays(spark, {f: getattr(lexicon, f) for f in Transducer.FIELDS})
    del lexicon
    shared = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shared.value), Transducer(load()))
        for batch in bounded(batches, 1):
            at = 0
            for part in slices(batch.column(1).to_pylist()):
                ids = encoder.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([encoder.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
                at += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(read_table(spark, sf_dir, "documents"), default_vocabulary()))
