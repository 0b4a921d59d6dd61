import hashlib

import duckdb
from pyspark.sql import functions as F

from sigspark.llm.exact_dedup import OP7_SQL, exact_dedup, op7_exact_dedup

UP = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").translate(UP), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        best = ids.index(keep)  # one of the rows that have the largest id
        out += [(i, keep, len(ids), k == best, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert got(op7_exact_dedup(spark, folder)) == sorted(map(tuple, duck.sql(OP7_SQL).fetchall()), key=str)


def test_odd_rows(odd_docs):
    from tests.llm.conftest import ODD_ROWS

    assert got(exact_dedup(odd_docs)) == brute(ODD_ROWS)


def test_repeated_rows_and_empty_table(make_docs):
    rows = [(1, "a"), (1, "a"), (2, "A"), (3, "b"), (3, "B"), (3, "b"), (None, "c"), (None, "C")]
    assert got(exact_dedup(make_docs(rows))) == brute(rows)
    assert exact_dedup(make_docs([])).count() == 0


def test_derived_tables(spark, make_docs, tmp_path):
    """Rows of a plan that makes more rows of one of a file, or other ones each time, aren't told apart by their place there."""
    make_docs([(i, f"t{i % 3}") for i in range(12)]).write.parquet(f"file://{tmp_path}/docs")
    table = spark.read.parquet(f"file://{tmp_path}/docs")
    twice = table.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    for docs in (twice, table.unionByName(table), table.filter("doc_id > 3"), table.withColumn("doc_id", F.col("doc_id") % 5)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = exact_dedup(docs).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == sorted((i, k, n, s) for i, k, n, _, s in brute(rows))
        assert sum(r.kept for r in out) == len({t for _, t in rows})
    assert exact_dedup(table.filter(F.rand() < 0.5)).filter("kept").count() <= 3


def test_full_bytes_split_colliding_digests(make_docs):
    rows = [(i, f"t{i % 7}") for i in range(40)]
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 0)
    assert got(exact_dedup(make_docs(rows), key=weak)) == brute(rows)


def test_hot_group_and_small_batches(make_docs):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(300)]
    assert got(exact_dedup(make_docs(rows), files_per_batch=1, hot_share=5)) == brute(rows)
