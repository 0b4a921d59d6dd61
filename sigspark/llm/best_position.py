"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

The index of a table has one row per document: its terms, their counts, and its length; beside it, how many documents
hold each term. It is searched where it stands: a task reads its rows in shards, orders each shard's lists by impact,
and answers all queries on them. Lists of a query's terms are read downwards; every document met is looked up in all
other lists by direct access, and both kinds of access mark positions. A list's best position is the last one up to
which all are marked. No document that wasn't met can score more than the sum of the impacts there, so a query is done
with when that sum is strictly below its k-th best score. The best of a task's shards so far carry over to the next.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise, read_table, scoped, text_bytes

#: What separates terms; bytes above 0x7F belong to them, and only A-Z is lowered.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
FOLDED = bytes(b if b > 0x7F or bytes([b]).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
ROWS = "doc_id long, n long, terms array<string>, counts array<int>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, terms, counts), a few rows at a time; rows without a term go."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            found = [(i, Counter(terms_of(text))) for i, text in enumerate(text_bytes(part.column(1)))]
            found = [(i, own) for i, own in found if own]
            ends = np.cumsum([0, *(len(own) for _, own in found)])
            terms = pa.array([t for _, own in found for t in own], pa.binary()).cast(pa.string())
            counts = pa.array(np.fromiter((c for _, own in found for c in own.values()), np.int32, ends[-1]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([own.total() for _, own in found], pa.int64()), *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (terms, counts))],
                names=["doc_id", "n", "terms", "counts"],
            )


@dataclass(frozen=True)
class Index:
    """``rows``: (doc_id, n, terms, counts) of every document that has a term; ``held``: (term, df); and the totals N and L."""

    rows: DataFrame
    held: DataFrame
    documents: int
    length: int


def build_index(docs: DataFrame) -> Index:
    """Index of all rows and whole texts, in tables below the shared folder. Null text has no term."""
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, ROWS))
    held = materialise(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    documents, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(rows, held, documents, length)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of ``size[0]`` numbers, and so on for each pair."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Shard:
    """Impact-ordered lists of some documents' terms; ``reads`` counts positions read downwards, of all queries."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, n: np.ndarray, vocabulary: int, documents: int, length: int):
        """From term numbers and counts, document by document; ``sizes``: terms of each document, ``n``: its length."""
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        m = 100 - 25 + (25 * n * documents) // max(1, length)
        impact = (1_000_000_000 * counts) // (1000 * counts + 12 * m[doc])
        order = np.lexsort((doc, -impact, terms))
        self.terms, self.sizes, self.first = terms, sizes, np.cumsum(sizes) - sizes
        self.list_doc, self.impact = doc[order], impact[order]
        self.place = np.empty(len(order), np.int32)  # of each document's terms: where they stand in the lists
        self.place[order] = np.arange(len(order), dtype=np.int32)
        self.starts = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.slot = np.full(vocabulary, -1, np.int32)
        self.marked, self.met, self.reads = np.zeros(len(order), bool), np.zeros(len(sizes), bool), 0

    def best(self, own: np.ndarray, gain: np.ndarray, best: Best, step: int = 16) -> None:
        """Add to ``best`` what this shard has for a query of terms ``own`` that gain ``gain`` times an impact."""
        start, size = self.starts[own], self.starts[own + 1] - self.starts[own]
        own, gain, start, size = (x[size > 0] for x in (own, gain, start, size))
        if not len(own) or best.least() > int(gain @ self.impact[start]):
            return
        self.slot[own] = np.arange(len(own))
        self.marked[:], self.met[:] = False, False
        position, depth = np.zeros(len(own), np.int64), 0
        while True:
            read = spans(start + depth, np.clip(size - depth, 0, step))
            self.reads += len(read)
            self.marked[read] = True
            docs = self.list_doc[read]
            docs = np.unique(docs[~self.met[docs]])
            self.met[docs] = True
            self.look_up(docs, gain, best)
            for j, (at, end) in enumerate(zip((start + position).tolist(), (start + size).tolist(), strict=True)):
                ahead = self.marked[at:end]
                position[j] += len(ahead) if not len(ahead) or ahead[k := int(ahead.argmin())] else k
            open_ = position < size
            if not open_.any() or best.least() > int(gain[open_] @ self.impact[(start + position - 1)[open_]]):
                break
            depth, step = depth + step, 2 * step
        self.slot[own] = -1

    def look_up(self, docs: np.ndarray, gain: np.ndarray, best: Best) -> None:
        """Direct access: the documents' places in all lists of the query, which are marked, and their scores."""
        size = self.sizes[docs]
        at = spans(self.first[docs], size)
        slot = self.slot[self.terms[at]]
        there = slot >= 0
        place = self.place[at[there]]
        self.marked[place] = True
        worth = np.zeros(len(at) + 1, np.int64)
        worth[1:][there] = gain[slot[there]] * self.impact[place]
        total = np.cumsum(worth)
        ends = np.cumsum(size)
        best.add(total[ends] - total[ends - size], docs)


class Best:
    """The k best of a query so far: scores and ids, null ids last among equal scores."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.shard: tuple[np.ndarray, np.ndarray] | None = None

    def least(self) -> int:
        """What a score must reach to be among them."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        near = scores >= max(1, self.least())
        ids, null = self.shard
        scores, ids, null = (np.concatenate([a, b]) for a, b in ((self.scores, scores[near]), (self.ids, ids[docs[near]]), (self.null, null[docs[near]])))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


@dataclass(frozen=True)
class Queries:
    """A block of queries: item numbers, and for each its terms (numbers in the vocabulary) and what they gain."""

    vocabulary: pa.Array
    items: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    gain: np.ndarray


def searched(batches: Iterator[pa.RecordBatch], queries: Queries, k: int, documents: int, length: int, most: int) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score): the k best of a task's rows. At most ``most`` terms, and those of one row more, are a shard."""
    best = [Best(k) for _ in queries.items]
    held: list[tuple] = []

    def flush() -> None:
        ids, null, n, sizes, terms, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        shard = Shard(terms, counts, sizes, n, len(queries.vocabulary), documents, length)
        for q, own in enumerate(best):
            own.shard = ids, null
            part = slice(queries.first[q], queries.first[q + 1])
            shard.best(queries.terms[part], queries.gain[part], own)

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            lists, ids = part.column(2), part.column(0)
            number = pc.index_in(lists.flatten(), value_set=queries.vocabulary)
            known = pc.is_valid(number).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.add.reduceat(np.append(known, False).astype(np.int64), np.cumsum(sizes) - sizes) if len(sizes) else sizes
            held.append((pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), part.column(1).to_numpy(), own, number.drop_null().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy()[known].astype(np.int64)))
            if sum(len(x[4]) for x in held) >= most:
                flush()
    if held:
        flush()
    item = np.repeat(queries.items, [len(b.scores) for b in best])
    if len(item):
        ids = pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.null for b in best]))
        yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(np.concatenate([b.scores for b in best]))], names=["item", "doc_id", "score"])


def block_of(pairs: pa.Table) -> Queries:
    pairs = pairs.sort_by("item")
    vocabulary = pairs.column("term").combine_chunks().unique()
    items, first = np.unique(pairs.column("item").to_numpy(), return_index=True)
    terms = pc.index_in(pairs.column("term"), value_set=vocabulary).to_numpy().astype(np.int64)
    return Queries(vocabulary, items, np.append(first, len(terms)), terms, pairs.column("gain").to_numpy())


def search(index: Index, queries: DataFrame, k: int = 20, block_pairs: int = 1 << 19, block_items: int = 1 << 13, shard_terms: int = 1 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each row of ``queries`` (item_id, text).

    Equal scores go by doc_id, null ids last. Rows that repeat an item_id are items of their own; items without a known term
    have no row. Queries go in blocks of some ``block_pairs`` pairs of item and term and ``block_items`` items, which is what
    is sent to tasks and what a task holds results for; each block reads the index once.
    """
    spark = queries.sparkSession
    own = queries.select(F.col("item_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, ROWS)
    items = materialise(own.withColumnRenamed("doc_id", "item_id").withColumn("item", F.monotonically_increasing_id()))
    pairs = items.select("item", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("item", "x.*").withColumnRenamed("terms", "term")
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.documents) + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    pairs = materialise(pairs.join(index.held, "term").select("item", "term", (weight * F.col("counts")).alias("gain")).filter("gain > 0"))
    documents, length = index.documents, index.length
    blocks = max(1, -(-pairs.count() // block_pairs), -(-items.count() // block_items))
    hits = None
    for b in range(blocks):
        block = block_of(pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow())
        shared = spark.sparkContext.broadcast(block)
        run = lambda batches, shared=shared: searched(batches, shared.value, k, documents, length, shard_terms)
        found = index.rows.mapInArrow(run, "item long, doc_id long, score long")
        hits = found if hits is None else hits.unionByName(found)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    top = hits.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


@scoped
def ranked(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Index all of ``docs`` (doc_id, text) and search it for ``queries`` (item_id, text), see ``search``.

    Null, empty and term-less texts are never found. Rows that repeat an id are documents of their own. Empty tables
    give no row. Other columns are ignored.
    """
    return search(build_index(docs), queries, k)


def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{SEPARATORS}]+') AS own FROM documents),
q AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{SEPARATORS}]+') AS own FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(own))::BIGINT AS n_terms FROM d WHERE len(own) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(own) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT item, term, count(*) AS qtf FROM (SELECT item, unnest(own) AS term FROM q) GROUP BY ALL),
w AS (SELECT item, term, qtf * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS gain FROM qt JOIN df USING (term), s),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(own) * n_docs) // n_terms) AS m FROM d, s WHERE len(own) > 0),
scores AS (SELECT item, r, doc_id, sum(gain * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM w JOIN tf USING (term) JOIN m USING (r) GROUP BY item, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM scores JOIN q USING (item) WHERE score > 0 QUALIFY rank <= 20
"""
