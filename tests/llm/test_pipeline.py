import hashlib
from collections import Counter

import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sigspark.llm.bpe_transducer import default_vocabulary
from sigspark.llm.exact_dedup import exact_dedup
from sigspark.llm.mixing import Settings as MixSettings
from sigspark.llm.mixing import bisect_exponent
from tests.llm.test_minhash_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect() if r.text and regex.search(r"\p{L}", r.text)]
    last = {}
    for i, t in rows:
        key = t.encode().lower()
        last[key] = max(i, last.get(key, i))
    rows = [(i, t) for i, t in rows if i in set(last.values())]
    kept = {i for i, _, _, keep in near_brute(rows) if keep}
    library = Tokenizer.from_file(default_vocabulary())
    library.no_truncation(), library.no_padding()
    want = {}
    for i, t in rows:
        if i in kept:
            ids = library.encode(t, add_special_tokens=False).ids
            raw = b"".join(x.to_bytes(4, "little") for x in ids)
            want[i] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    out = corpus_pipeline.run(spark, SF).collect()
    times = Counter(r.doc_id for r in out)
    assert times.keys() == want.keys()
    sources = {r.doc_id: r.source or "" for r in documents.collect()}
    words = {i: max(1, len(t.encode().split())) for i, t in rows if i in kept}
    sizes, drawn = Counter(), Counter()
    for i, n in words.items():
        sizes[sources[i]] += n
        drawn[sources[i]] += n * times[i]
    table = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, docs long, tokens long")
    exponent = bisect_exponent(table, MixSettings())
    whole = max(n ** (1 - exponent) for n in sizes.values()) * sum(n**exponent for n in sizes.values())
    for s, n in sizes.items():  # multiplicities meet the budget, but for the document that reaches it
        budget = round(whole * n**exponent / sum(m**exponent for m in sizes.values()))
        assert budget <= drawn[s] < budget + max(w for i, w in words.items() if sources[i] == s)
        assert {times[i] for i in words if sources[i] == s} <= {budget // n, budget // n + 1}
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in out)


def test_stages_keep_the_columns(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "mixing", "bpe"]
    docs = documents.limit(30)
    path = corpus_pipeline.materialise(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, path, SF)
        assert out.columns == documents.columns
        path = corpus_pipeline.materialise(out)


def test_odd_rows(spark, odd_docs, make_docs):
    labelled = odd_docs.withColumn("lang", F.lit("en"))
    docs = corpus_pipeline.materialise(labelled)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
    assert {r.doc_id for r in docs.collect()} == {4, 7, 8, 10}
    docs = corpus_pipeline.materialise(make_docs([]))
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
    assert docs.count() == 0


def test_repeated_rows_and_null_ids(spark, make_docs):
    """One row of three equal ones stays; different texts under one id, and texts without an id, stay."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "same text here", "en", "a")] * 3 + [(2, "one thing", "en", "a"), (2, "another thing", "en", "a"), (None, "without id", "en", "b"), (None, "WITHOUT id", "en", "b"), (3, long, None, "b"), (4, long + " end", "en", "b")]
    docs = corpus_pipeline.materialise(make_docs(rows))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
        assert docs.columns == make_docs([]).columns, k
    assert sorted((str(r.doc_id), r.text.lower()[:12]) for r in docs.collect()) == sorted(
        [("1", "same text he"), ("2", "one thing"), ("2", "another thin"), ("None", "without id"), ("3", long[:12])]
    )
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert Counter(r.text for r in mixed.collect()) == Counter({r.text: 2 if r.source == "a" else 1 for r in docs.collect()})  # the small source comes twice


def test_near_copies_with_null_ids(spark, make_docs):
    """The smallest id stays, and a null one only where there is no other."""
    long, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(None, long + " a"), (5, long + " b"), (9, long + " c"), (None, other + " a"), (None, other + " b"), (7, "alone")]
    out = corpus_pipeline.STAGES[2][1](spark, corpus_pipeline.materialise(make_docs(rows)), SF).collect()
    assert sorted((str(r.doc_id), r.text[:2]) for r in out) == [("5", "w0"), ("7", "al"), ("None", "v0")]


def test_no_language_to_learn_from(spark, make_docs):
    docs = corpus_pipeline.materialise(make_docs([(1, "some text"), (2, "other text"), (3, "123")]))
    out = corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in out) == [1, 2]


def test_results_outlive_a_run(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, "A b"), (3, "c")])
    held = exact_dedup(docs)
    corpus_pipeline.run(spark, SF).count()
    assert sorted(r.doc_id for r in held.collect()) == [1, 2, 3]
