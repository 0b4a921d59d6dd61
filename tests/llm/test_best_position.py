import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sigspark.llm.best_position import OP11_SQL, Best, Shard, build_index, op11_best_position, ranked, search, terms_of
from tests.llm.conftest import ODD_ROWS

TERM = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall((text or "").encode().lower())


def brute(docs, items, k=20):
    own = [(i, Counter(split(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, length = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            m = 100 - 25 + (25 * c.total() * n) // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in Counter(split(text)).items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def items_of(spark, items):
    return spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, doc_id string, n int")


def test_terms():
    assert [terms_of(t.encode()) for t in ("", "A-b_c 1é È\x00ñ\x7fZ", "中 文")] == [split(t) for t in ("", "A-b_c 1é È\x00ñ\x7fZ", "中 文")]
    every = bytes(range(256))
    assert terms_of(every) == TERM.findall(every.lower())


def test_odd_rows(spark, odd_docs):
    items = [(1, "One two THREE one"), (1, "word x"), (2, None), (3, "..."), (None, "three ñ"), (4, "absent")]
    assert got(ranked(odd_docs, items_of(spark, items), k=3)) == brute([r[:2] for r in ODD_ROWS], items, 3)


def test_ties_repeated_rows_and_empty_tables(spark, make_docs):
    docs = [(i, "a b c") for i in range(30)] + [(3, "a b c"), (None, "a b c"), (40, "d"), (41, "d e"), (42, "f")]
    items = [(1, "a"), (2, "d d e"), (3, "f a")]
    assert got(ranked(make_docs(docs), items_of(spark, items))) == brute(docs, items)
    assert ranked(make_docs([]), items_of(spark, items)).collect() == []
    assert ranked(make_docs(docs), items_of(spark, [])).collect() == []


@pytest.mark.parametrize("shard_terms, block_items", [(200, 3), (1 << 20, 1 << 13)])
def test_shards_and_blocks(spark, documents, shard_terms, block_items):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(8).collect()]
    out = search(build_index(documents), items_of(spark, items), 5, block_items=block_items, shard_terms=shard_terms)
    assert got(out) == brute(docs, items, 5)


def test_stops_early_and_strictly():
    """Two terms on 10,000 documents: the first lists end the search; ties at the k-th score are all met."""
    rng = np.random.default_rng(3)
    counts = rng.geometric(0.01, (10_000, 2)).astype(np.int64)
    counts[rng.choice(10_000, 40, replace=False)] = 4000  # equal best impacts
    n = counts.sum(1) * 0 + 10_000
    shard = Shard(np.tile([0, 1], 10_000), counts.ravel(), np.full(10_000, 2), n, 2, 10_000, int(n.sum()))
    best = Best(20)
    best.shard = np.arange(10_000), np.zeros(10_000, bool)
    shard.best(np.array([0, 1]), np.array([3, 2]), best)
    impact = (1_000_000_000 * counts) // (1000 * counts + 12 * 100)
    score = impact @ np.array([3, 2])
    want = np.lexsort((np.arange(10_000), -score))[:20]
    assert best.ids.tolist() == want.tolist() and best.scores.tolist() == score[want].tolist()
    assert shard.reads < 2000


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    assert got(op11_best_position(spark, folder)) == sorted(map(tuple, duck.sql(OP11_SQL).fetchall()), key=str)
