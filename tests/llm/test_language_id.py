import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from sigspark.llm.common import bounded
from sigspark.llm.language_id import Presence, Settings, accepted, codes_of, identify, prepared, presence_rows


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd_docs, make_docs):
    rows = [(100 + i, t, g) for i, (t, g) in enumerate([("the and of with", "en"), ("le la les avec", "fr")] * 20)]
    docs = make_docs(rows).unionByName(odd_docs)
    out = {r.doc_id: r for r in identify(docs).collect()}
    assert {out[i].lang_pred for i in (1, 2, 3, 11)} == {"und"} and out[1].score == 0
    assert out[100].lang_pred == "en" and out[101].lang_pred == "fr"
    assert {r.lang_pred for r in identify(odd_docs).collect()} == {"und"}
    assert identify(make_docs([])).count() == 0


def test_rows_that_share_ids(make_docs):
    """A language whose rows have one id, or are one row again and again, is learnt like any other."""
    rows = [(1, f"alpha beta gamma {i}", "xx") for i in range(900)] + [(10 + i, f"zu zi zo {i}", "yy") for i in range(900)] + [(4, "qwq kwk", "zz")] * 900
    out = identify(make_docs(rows), Settings(per_lang=20, landmarks=5)).collect()
    assert Counter(r.lang_pred for r in out) == {"xx": 900, "yy": 900, "zz": 900}


def test_most_frequent_languages_are_learnt(make_docs):
    rows = [(i, f"w{i % 5} word{i % 5}", f"l{i % 5}") for i in range(50)] + [(100 + i, "rare", "z") for i in range(2)]
    out = identify(make_docs(rows), Settings(most_landmarks=5)).collect()
    assert {r.lang_pred for r in out} <= {f"l{i}" for i in range(5)}


def test_parts_of_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "b" * 20, "", "c", "d" * 9])], names=["text"])
    parts = list(bounded([batch, batch.slice(0, 0)], 0, 10))
    assert [p.column(0).to_pylist() for p in parts if p.num_rows] == [["a" * 5, None], ["b" * 20], ["", "c", "d" * 9]]


def test_kernel_against_sets():
    texts = [b"abcabc", b"bcd", b"xyzzy abc", b"a"]
    grams = [np.unique(codes_of(b"abcd abc", w)) for w in (1, 2, 3)]
    look = Presence((1, 2, 3), grams)
    rows = presence_rows(texts, look, sum(map(len, grams)))
    known = {w: {b"abcd abc"[i : i + w] for i in range(9 - w)} for w in (1, 2, 3)}
    for t, row in zip(texts, rows, strict=True):
        own = {(w, t[i : i + w]) for w in (1, 2, 3) for i in range(len(t) - w + 1)}
        assert np.isclose(row.sum(), sum(g in known[w] for w, g in own) / len(own) ** 0.5)
    assert prepared("É") == " é ".encode() and Settings().held == 2


def grams(text):
    raw = b" " + text.lower().encode() + b" "
    return {(w, raw[i : i + w]) for w in (1, 2, 3) for i in range(len(raw) - w + 1)}


def test_against_direct_kernel_ridge(spark, documents):
    """All learnt rows are landmarks: kernels from Python sets, one linear solve."""
    docs = documents.filter("length(text) < 3000 and lang is not null").orderBy("doc_id").limit(60)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    sets = {i: grams(t) for i, t, _ in rows}
    train = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({g for _, g in train})
    k = lambda a, b: len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5
    inside = np.array([[k(a, b) for b, _ in train] for a, _ in train])
    target = np.array([[1.0 if g == x else -1.0 for x in langs] for _, g in train])
    left = inside.T @ inside + 1e-2 * len(train) * inside + 1e-8 * np.eye(len(train))
    weights = np.linalg.solve(left, inside.T @ target)
    out = {r.doc_id: r for r in identify(docs, Settings(ridge=1e-2, landmarks=300)).collect()}
    for i, _, _ in rows:
        value = np.array([k(i, b) for b, _ in train]) @ weights
        assert abs(out[i].score - min(1, max(0, (1 + value.max()) / 2))) < 1e-3
        if np.sort(value)[-1] - np.sort(value)[-2] > 1e-2:
            assert out[i].lang_pred == langs[value.argmax()]


def test_many_languages_share_the_bounds(make_docs):
    assert Settings().shares(4) == (300, 40) and Settings().shares(500) == (40, 2) and Settings().shares(30_000) == (1, 1)
    docs = make_docs([(i, f"word{i} text", f"l{i % 12}") for i in range(60)])
    assert {r.lang_pred for r in identify(docs, Settings(most_landmarks=12, most_rows=24)).collect()} <= {f"l{i}" for i in range(12)}


def test_accepted_rows(make_docs, odd_docs):
    kept = accepted(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["4", "5", "6", "7", "8", "9", "10", "None"])
    rows = [(100 + i, t, g) for i, (t, g) in enumerate([("the and of with", "en"), ("le la les avec", "fr")] * 20)] + [(7, "the with", None), (7, "les avec", "xx")]
    assert sorted(r.lang for r in accepted(make_docs(rows)).filter("doc_id = 7").collect()) == ["en", "xx"]
