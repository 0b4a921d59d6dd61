"""Short license notices in texts, exact and with errors.

A notice that may have k errors is split into k + 1 pieces: a match with at most k errors has one
piece unchanged. Pieces are searched as exact seeds; around each seed the bounded-error matching of
the regex library decides, and its spans are reported.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_bytes

#: Exact phrases and their labels, as words.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that are searched with errors, as words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
}
#: Bytes of words: digits, small letters and all of other scripts; the rest parts words.
WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    errors: int

    @property
    def seeds(self) -> list[tuple[int, bytes]]:
        """errors + 1 pieces of about the same length, with their offsets."""
        n, k = len(self.text), self.errors + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    @property
    def matcher(self) -> regex.Pattern:
        # A match begins and ends with a word; (?b) asks for the fewest errors.
        return regex.compile(rb"(?b)(?<=\x20)(?:%s){e<=%d}(?=\x20)" % (regex.escape(self.text), self.errors))


def errors_for(text: str) -> int:
    """One error in ten characters, four at most."""
    return min(4, len(text) // 10)


def notices(table: dict[str, str]) -> list[Notice]:
    return [Notice(t.encode(), label, errors_for(t)) for t, label in table.items()]


def words_of(text: bytes) -> bytes:
    """Lower-cased words between single spaces, with a space before and after."""
    return b" ".join([b"", *text.translate(WORD).split(), b""]) if text else b" "


def exact_places(words: bytes, phrase: bytes) -> list[int]:
    """Byte places (of the space before) where the phrase's words stand."""
    probe, out, at = b" " + phrase + b" ", [], 0
    while (at := words.find(probe, at)) >= 0:
        out.append(at)
        at += 1
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str], fuzzy: dict[str, str]):
        self.phrases = [(p.encode(), label) for p, label in phrases.items()]
        self.notices = [(n, n.seeds, n.matcher) for n in notices(fuzzy)]

    def windows(self, words: bytes, notice: Notice, seeds: list[tuple[int, bytes]]) -> set[tuple[int, int]]:
        """Stretches around seeds, hardly longer than the notice, that hold every match with at most its errors."""
        k, n, found = notice.errors, len(notice.text), set()
        for offset, seed in seeds:
            at = words.find(seed)
            while at >= 0:
                found.add((max(0, at - offset - k - 1), min(len(words), at - offset + n + k + 1)))
                at = words.find(seed, at + 1)
        return found

    def fuzzy(self, words: bytes) -> list[tuple[str, int, int, int, int]]:
        """(label, first byte, last byte, errors, length of the notice) of the matches, notice by notice.

        The best match anywhere is taken first; what it leaves of a window is searched again, so that
        no match remains that meets none of the taken ones.
        """
        out = []
        for notice, seeds, matcher in self.notices:
            queue: list[tuple[int, int, int, int, int]] = []

            def search(a: int, b: int, queue=queue, notice=notice, matcher=matcher) -> None:
                m = matcher.search(words, a, b) if b - a > len(notice.text) - notice.errors else None
                if m:
                    heapq.heappush(queue, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

            for window in self.windows(words, notice, seeds):
                search(*window)
            starts, ends = [], []  # of the taken matches, by place
            while queue:
                errors, start, end, a, b = heapq.heappop(queue)
                i = bisect_left(ends, start)
                if i == len(starts) or starts[i] >= end:
                    starts.insert(i, start)
                    ends.insert(i, end)
                    out.append((notice.label, start, end, errors, len(notice.text)))
                for j in range(bisect_left(ends, a + 1), len(starts)):  # the parts of the window before and between the taken ones
                    if starts[j] >= b:
                        break
                    search(a, starts[j])
                    a = ends[j]
                else:
                    j = len(starts)
                search(a, b)
        return out

    def __call__(self, text: bytes) -> tuple[int, list[tuple]]:
        """Number of words, and spans (label, method, first word, last word, errors, score) by place."""
        words = words_of(text)
        spans, gaps = [], None

        def place(at: int) -> int:
            """Number of the word behind the last space up to a byte."""
            nonlocal gaps
            gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20) if gaps is None else gaps
            return int(np.searchsorted(gaps, at, "right")) - 1

        for phrase, label in self.phrases:
            more = phrase.count(b" ")
            spans += [(label, "exact", p, p + more, 0, 1.0) for p in map(place, exact_places(words, phrase))]
        for label, a, b, errors, n in self.fuzzy(words):
            spans.append((label, "fuzzy", place(a - 1), place(b) - 1, errors, 1 - errors / n))
        return max(0, words.count(b" ") - 1), sorted(spans, key=lambda s: (s[2], s[3], s[0], s[1]))


SPAN = pa.struct([("label", pa.string()), ("method", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64()), ("score", pa.float64())])
SCHEMA = "doc_id long, n_words long, spans array<struct<label: string, method: string, first_word: long, last_word: long, errors: long, score: double>>"


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, fuzzy: dict[str, str] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans.

    A span has its label, method (exact or fuzzy), first and last word from 0, errors and score. Null
    counts as empty: no words, no spans. Repeated rows and null ids are scanned row by row; an empty
    table gives no row; other columns are ignored. Needs no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, fuzzy)
        for batch in batches:
            found = [scanner(t) for t in text_bytes(batch.column(1))]
            spans = [[dict(zip(SPAN.names, s, strict=True)) for s in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "n_words", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.filter("spans", lambda s: s.method == "exact")
    starts = F.transform(F.col("base"), lambda s: s.first_word)
    joined = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))))
    return scan(read_table(spark, sf_dir, "documents")).withColumn("base", exact).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("score"),
    )
