import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm.merkle_manifest import OP13_SQL, build_manifest, manifest, op13_merkle_manifest, position, proofs
from tests.llm.conftest import ODD_ROWS


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def steps_of(levels, i):
    for row in levels[:-1]:
        left, right = (row[i - 1], None) if i % 2 else (None, row[i + 1] if i + 1 < len(row) else None)
        yield left, right
        i //= 2


def brute(rows, tamper=lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0):
    """From (doc_id, source, lang, n_chars, text)."""
    parts = defaultdict(list)
    for r in rows:
        parts[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels_of([x[2] for x in sorted(parts[p], key=lambda x: x[:3])]) for p in order]
    top = levels_of([t[-1][0] for t in trees]) if trees else None
    out = []
    for number, p in enumerate(order):
        for i, (*_, leaf, r) in enumerate(sorted(parts[p], key=lambda x: x[:3])):
            changed = leaf_of((r[0], r[1], r[2], r[3] + 1, r[4])) if tamper(r[0]) and r[3] is not None else leaf
            proof, h = "", changed
            for left, right in [*steps_of(trees[number], i), *steps_of(top, number)]:
                proof += (left or "") + (right or "")
                h = sha((left or "") + h + (right or ""))
            out.append((r[0], leaf, trees[number][-1][0], top[-1][0], sha(proof), h, h == top[-1][0]))
    return sorted(out, key=str)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def five(docs):
    return [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in docs.collect()]


@pytest.mark.parametrize("n", range(1, 40))
def test_positions_are_those_of_a_log_in_postorder(n):
    log = []

    def visit(level, index):
        if level:
            for child in (2 * index, 2 * index + 1):
                if child << (level - 1) < n:
                    visit(level - 1, child)
        log.append((level, index))

    visit((n - 1).bit_length(), 0)
    assert [int(position(level, np.array([i]), n)[0]) for level, i in log] == list(range(len(log)))


@pytest.mark.parametrize("k", [1, 2, 10])
def test_odd_rows_and_many_parts(spark, make_docs, k):
    rows = [*ODD_ROWS, *[(i, f"t{i}", ["a", "é", None, ""][i % 4], "s" if i % 2 else None, None if i % 9 == 0 else i) for i in range(50)], *[(100 + i, "x", "b", "s", 3) for i in range(33)], (200, "only", "z", "s", 1)]
    docs = make_docs(rows)
    assert got(manifest(docs, tampered(), k=k)) == brute(five(docs))


def test_repeated_rows_one_row_and_empty_table(make_docs):
    rows = [(1, "a", "en", "s", 1)] * 5 + [(None, "b", "en", "s", 2)] * 4 + [(1, "c", "en", "s", 1)]
    docs = make_docs(rows)
    assert got(manifest(docs, tampered(), k=2)) == brute(five(docs))
    docs = make_docs(rows[:1])
    assert got(manifest(docs, k=2)) == brute(five(docs), lambda i: False)
    assert manifest(make_docs([]), tampered()).collect() == []


def test_log_is_whole_and_in_order(spark, documents):
    leaves = documents.select(F.col("lang").alias("part"), F.col("doc_id").alias("key"), F.unhex(F.sha2("text", 256)).alias("hash"), "doc_id")
    m = build_manifest(leaves, k=3)
    by_tree = defaultdict(list)
    for r in m.log.collect():
        by_tree[r.tree].append(r.pos)
    assert all(sorted(x) == list(range(len(x))) for x in by_tree.values())
    langs = documents.select("lang").distinct().count()
    assert len(by_tree) == langs + 1
    assert proofs(m).count() == documents.count()


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    out = got(op13_merkle_manifest(spark, folder))
    assert out == sorted(map(tuple, duck.sql(OP13_SQL).fetchall()), key=str)
    assert 0 < sum(not r[-1] for r in out) < len(out)
