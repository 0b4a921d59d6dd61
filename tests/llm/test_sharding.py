import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from sigspark.llm.common import numbered
from sigspark.llm.sharding import FACTOR, LOW, OP12_SQL, Shuffle, assign, op12_feistel_shards, write_shards
from tests.llm.conftest import ODD_ROWS


def walked(x, n, keys, half):
    """The network and the walk, number by number."""
    while True:
        left, right = divmod(x, 1 << half)
        for factor, summand in keys:
            u = (right * factor + summand) % (LOW + 1)
            left, right = right, left ^ ((((u ^ (u >> 15)) * FACTOR) % (LOW + 1)) >> (31 - half))
        x = left * (1 << half) + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation_and_its_inverse(n):
    s = Shuffle(n, 8)
    out = s.walked(np.arange(n))
    assert out.tolist() == [walked(x, n, s.keys, s.half) for x in range(n)]
    assert sorted(out) == list(range(n))
    assert (s.row_at(*s.place(np.arange(n))) == np.arange(n)).all()
    assert (Shuffle(n, 8, seed=8).walked(np.arange(n)) != out).any() or n < 8


def test_numbers_of_any_size():
    s = Shuffle(3 * 10**15)
    rows = np.array([0, 1, 10**9, 3 * 10**15 - 1])
    assert (s.row_at(*s.place(rows)) == rows).all()


def test_looks_shuffled():
    at = Shuffle(100_000).walked(np.arange(100_000))
    assert abs(np.corrcoef(np.arange(100_000), at)[0, 1]) < 0.02
    neighbours = np.abs(np.diff(at)).mean()
    assert 0.9 < neighbours / (100_000 / 3) < 1.1
    counts = np.bincount(at[:10_000] // 1000, minlength=100)
    assert 40 < counts.min() and counts.max() < 180


def brute(rows, shards=8, seed=7):
    cells = sorted(((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows))
    s = Shuffle(len(rows), shards, seed)
    out = []
    for number, (null, i, size, crc) in enumerate(cells):
        at = walked(number, len(rows), s.keys, s.half)
        out.append((None if null else i, size, crc, "rows", at % shards, at // shards, None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_rows(odd_docs):
    assert got(assign(odd_docs)) == brute(ODD_ROWS)


def test_repeated_rows_fewer_rows_than_shards_and_empty_table(make_docs):
    rows = [(1, "a")] * 40 + [(None, "b")] * 30 + [(i, "c") for i in range(50)]
    assert got(assign(make_docs(rows), shards=7, seed=3)) == brute(rows, 7, 3)
    few = [(1, "a"), (2, None)]
    assert got(assign(make_docs(few))) == brute(few)
    assert assign(make_docs([])).collect() == []


def test_any_partitions_give_the_same_places(spark, documents):
    first = got(assign(documents.repartition(1)))
    assert first == got(assign(documents.repartition(13, "text")))
    slots = defaultdict(list)
    for r in first:
        slots[r[4]].append(r[5])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_numbers_of_a_hot_key(spark):
    rows = spark.range(0, 5000, 1, 13).selectExpr("if(id % 3 = 0, -1, id) AS a")
    out = sorted((r.number, r.a) for r in numbered(rows, "a").collect())
    assert out == list(enumerate(sorted(-1 if i % 3 == 0 else i for i in range(5000))))


def test_written_shards(spark, documents, tmp_path):
    write_shards(documents, f"file://{tmp_path}/shards", rows_per_file=17)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    want = {(r.doc_id, r.shard, r.slot) for r in assign(documents).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == want
    assert set(documents.columns) <= set(back.columns)


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert got(op12_feistel_shards(spark, folder)) == sorted(map(tuple, duck.sql(OP12_SQL).fetchall()), key=str)
