"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get numbers 0..n-1 in the order of their ids. A keyed Feistel network permutes the least domain of an
even number of bits that holds n numbers; results outside 0..n-1 are permuted again until they fall inside
(cycle walking), which leaves a permutation of exactly n numbers. The permuted number p puts a row into shard
p mod k at slot p div k: a shuffle that any task can compute for any row, and undo for any slot, from (n, k, seed).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, read_table, scoped, scratch

#: The mixing constant of a round, and its width: products of two such numbers fit into 63 bits.
FACTOR, WIDTH = 0x5BD1E995 & 0x7FFFFFFF, 31
LOW = (1 << WIDTH) - 1


@dataclass(frozen=True)
class Shuffle:
    """A permutation of ``rows`` row numbers, dealt out to ``shards`` shards whose counts differ by one at most."""

    rows: int
    shards: int = 8
    seed: int = 7
    rounds: int = 6

    @cached_property
    def half(self) -> int:
        """Bits of each half of the network's domain."""
        return max(1, (max(0, self.rows - 1).bit_length() + 1) // 2)

    @cached_property
    def keys(self) -> list[tuple[int, int]]:
        """An odd factor and a summand of each round."""
        digests = (hashlib.sha256(f"{self.seed}|{r}".encode()).digest() for r in range(self.rounds))
        return [(int.from_bytes(d[:4], "little") & LOW | 1, int.from_bytes(d[4:8], "little") & LOW) for d in digests]

    def mixed(self, x: np.ndarray, key: tuple[int, int]) -> np.ndarray:
        """The round function: its highest bits, as low bits of a product depend on few others."""
        u = (x * key[0] + key[1]) & LOW
        return (((u ^ (u >> 15)) * FACTOR) & LOW) >> (WIDTH - self.half)

    def network(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        left, right = x >> self.half, x & ((1 << self.half) - 1)
        for key in self.keys[::-1] if back else self.keys:
            left, right = (right ^ self.mixed(left, key), left) if back else (right, left ^ self.mixed(right, key))
        return (left << self.half) | right

    def walked(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        """Permuted again while outside; under 4 turns on average, as the domain is under 4 times as large."""
        out = self.network(np.asarray(x, np.int64), back)
        while (outside := np.flatnonzero(out >= self.rows)).size:
            out[outside] = self.network(out[outside], back)
        return out

    def place(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of row numbers."""
        at = self.walked(row)
        return at % self.shards, at // self.shards

    def row_at(self, shard: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The row number that stands at a slot of a shard."""
        return self.walked(np.asarray(slot, np.int64) * self.shards + shard, back=True)


def permuted(number: Column, shuffle: Shuffle) -> Column:
    @F.pandas_udf("long")
    def run(numbers: pd.Series) -> pd.Series:
        return pd.Series(shuffle.walked(numbers.to_numpy()))

    return run(number)


def dealt(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows with a ``number`` 0..n-1, with shard and slot in its place."""
    own = [c for c in rows.columns if c != "number"]
    at = rows.withColumn("at", permuted(F.col("number"), Shuffle(rows.count(), shards, seed)))
    return at.select(*own, (F.col("at") % shards).cast("int").alias("shard"), F.expr(f"at div {shards}").alias("slot"))


@scoped
def assign(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Row numbers go by doc_id (null ids last), then size and crc32 of the text, so the result depends neither on
    files nor on partitions; rows equal in all of these get the same set of places in any order. The law is
    ``rows``: shards differ by one row at most, and slots of a shard are gapless from 0, so equal texts are not
    held together; grown_shard is null, as another number of shards is another shuffle. Null text counts as empty.
    With fewer rows than shards, the last shards are empty. An empty table gives no row. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = dealt(numbered(narrow, F.col("doc_id").asc_nulls_last(), "size", "text_crc32"), shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 7, rows_per_file: int = 100_000) -> None:
    """Whole rows as Parquet, one folder a shard, rows in order of their slots inside files and from file to file.

    Same places as ``assign`` gives. A shard is as many files as it takes: its slots are dealt out in runs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with scratch(docs.sparkSession):
        rows = numbered(docs, F.col("doc_id").cast("long").asc_nulls_last(), F.octet_length(text), F.crc32(text.cast("binary")))
        placed = dealt(rows, shards, seed).withColumn("_run", F.expr(f"slot div {rows_per_file}"))
        placed.repartition("shard", "_run").sortWithinPartitions("shard", "_run", "slot").drop("_run").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"))


def network_sql(source: str, shuffle: Shuffle) -> str:
    """Selects number, n, h and the network's value of ``x`` from a source of number, n, h and x."""
    out = f"SELECT number, n, h, x >> h AS a, x & ((1::BIGINT << h) - 1) AS b FROM {source}"
    for factor, summand in shuffle.keys:
        u = f"((b * {factor} + {summand}) & {LOW})"
        out = f"SELECT number, n, h, b AS a, xor(a, ((xor({u}, {u} >> 15) * {FACTOR}) & {LOW}) >> ({WIDTH} - h)) AS b FROM ({out})"
    return f"SELECT number, n, h, (a << h) | b AS x FROM ({out})"


#: crc32 of a list of bytes by a table that is made from the polynomial.
CRC_TABLE = "SELECT list(list_reduce([i::BIGINT] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS entries FROM range(256) r(i)"
CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295)"

OP12_SQL = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {CRC.format(text="coalesce(text, '')")} AS text_crc32 FROM documents, t),
m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM d),
s AS (SELECT number, n, ((length(bin(n - 1)) + 1) // 2)::INT AS h, number AS x FROM m),
v AS (SELECT * FROM ({network_sql("s", Shuffle(1))})
      UNION ALL SELECT * FROM ({network_sql("(SELECT * FROM v WHERE x >= n)", Shuffle(1))}))
SELECT m.doc_id, m.size, m.text_crc32, 'rows' AS law, (v.x % 8)::INT AS shard, (v.x // 8)::BIGINT AS slot, NULL::INT AS grown_shard
FROM m JOIN v ON m.number = v.number AND v.x < v.n
"""
