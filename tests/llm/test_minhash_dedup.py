import random

import duckdb
import numpy as np

from sigspark.llm.components import components
from sigspark.llm.minhash_dedup import OP10_SQL, Plan, near_duplicates, odd_sketches, permutations, min_samples, shingle_set, WordHashes


def sets_of(rows, width=5):
    out = {}
    for doc_id, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().lower().split()]
        n = max(1, len(words) - width + 1)
        out[doc_id] = {tuple(words[i : i + width]) for i in range(n)} if words else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 4 * min(len(sets[i]), len(sets[j])) >= 3 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(map(tuple, docs.select("doc_id", "text").collect()))
    assert got(near_duplicates(docs)) == want
    duck = duckdb.connect()
    duck.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert sorted(duck.sql(OP10_SQL).fetchall()) == want


def test_chains_and_families(make_docs):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):  # a family at many distances, some over chains only
        words = list(base)
        for _ in range(rnd.randrange(0, 7)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    words = list(base)
    for i in range(150, 200):
        words = words[2:] + [f"c{i}a", f"c{i}b"]
        rows.append((i, " ".join(words)))
    assert got(near_duplicates(make_docs(rows))) == brute(rows)


def test_odd_rows(odd_docs, make_docs):
    from tests.llm.conftest import ODD_ROWS

    rows = [r for r in ODD_ROWS if r[0] is not None]
    out = got(near_duplicates(odd_docs.filter("doc_id is not null")))
    assert out == brute(rows)
    nulls = near_duplicates(odd_docs).filter("doc_id is null").collect()
    assert [(r.component_id, r.kept) for r in nulls] == [(None, True)] * 2
    assert near_duplicates(make_docs([])).count() == 0


def test_sketches_estimate():
    plan = Plan()
    a, b = permutations(plan.samples)
    words = WordHashes()
    texts = [b" ".join(b"%d" % i for i in range(s, s + 400)) for s in (0, 0, 40, 5000)]
    samples = np.stack([min_samples(shingle_set(t, 5, words), a, b) for t in texts])
    sketches = odd_sketches(samples, plan.bits)
    ones = lambda i, j: int(np.bitwise_count(sketches[i] ^ sketches[j]).sum())
    assert ones(0, 1) == 0 and ones(0, 2) <= plan.most_bits < ones(0, 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    out = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_boilerplate_in_large_buckets(make_docs):
    """Texts that share a passage, some with near copies: large buckets without a main component."""
    rnd = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for i in range(240):
        own = [f"o{i}x{k}" for k in range(rnd.choice([10, 14, 18, 40]))]
        rows.append((i, " ".join(common + own)))
        if i % 6 == 0:
            own[rnd.randrange(len(own))] = "other"
            rows.append((1000 + i, " ".join(common + own)))
    assert got(near_duplicates(make_docs(rows), Plan(most_together=16))) == brute(rows)
    assert got(near_duplicates(make_docs(rows))) == brute(rows)
