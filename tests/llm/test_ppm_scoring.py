import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigspark.llm.ppm_scoring import END, PAD, SYMBOLS, Scorer, Settings, Trie, ppm_scores


def lower(text):
    return (text or "").encode().lower()


def trie_of(texts, order):
    trie = defaultdict(Counter)
    for t in texts:
        raw = bytes([PAD]) * order + t + bytes([END])
        for i in range(order, len(raw)):
            for k in range(order + 1):
                trie[raw[i - k : i]][raw[i]] += 1
    return trie


def walk(trie, context, symbol):
    """One symbol's log10 probability, context by context, with the excluded symbols in a set."""
    while context and context not in trie:
        context = context[1:]
    excluded, log = set(), 0.0
    while True:
        seen = trie.get(context, {})
        left = {s: n for s, n in seen.items() if s not in excluded}
        size = sum(seen.values()) - sum(n - 0.5 for s, n in seen.items() if s in excluded)
        if symbol in left:
            return log + math.log10((left[symbol] - 0.5) / size)
        if seen:
            log += math.log10(size - sum(n - 0.5 for n in left.values())) - math.log10(size)
        excluded |= left.keys()
        if not context:
            return log - math.log10(SYMBOLS - len(excluded))
        context = context[1:]


def brute(rows, order=6):
    train = [lower(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    trie = trie_of(train, order)
    counts = Counter(w for t in train for w in t.split())
    if train:
        counts["end"] = len(train)
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for i, text in rows:
        tokens = [*lower(text).split(), "end"]
        raw = bytes([PAD]) * order + lower(text) + bytes([END])
        score = sum(walk(trie, raw[p - order : p], raw[p]) for p in range(order, len(raw)))
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), total, base, score)
    return out


def same(docs, want, **options):
    rows = ppm_scores(docs, Settings(**options)).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9, abs=1e-9) and r.score == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def test_against_a_walk(make_docs):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "the hat", None, "", "A b\tc\x0bd", "zé zé 中", "the the cat", "qqqq x", "cat sat hat the"] * 3)]
    same(make_docs(rows), brute(rows))
    same(make_docs(rows), brute(rows), least_word=0.5)
    assert ppm_scores(make_docs([])).count() == 0
    alone = [(i, "abc") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    same(make_docs(alone), brute(alone))


def test_rare_contexts_count(make_docs, documents):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "the hat", None, "", "A b\tc\x0bd", "zé zé 中", "the the cat", "qqqq x", "cat sat hat the"] * 3)]
    for order in (0, 2, 6):
        for least_gram in (1.0, 0.02):
            same(make_docs(rows), brute(rows, order), order=order, least_gram=least_gram)
    rows = [(r.doc_id, r.text) for r in documents.limit(60).collect()]
    same(make_docs(rows), brute(rows), least_gram=1 / 500)


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute(rows, 2)
    for r in ppm_scores(documents, Settings(order=2)).collect():
        assert r.score == pytest.approx(want[r.doc_id][5], rel=1e-9)


def test_longer_contexts_help_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    score = {k: sum(r.score for r in ppm_scores(docs, Settings(order=k)).collect() if r.held_out) for k in (1, 3, 5)}
    assert score[1] < score[3] < score[5]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 101, 40).tolist()) for _ in range(30)]
    raw = trie_of(texts, 2)
    tables = []
    for k in range(3):
        own = sorted((int.from_bytes(c, "big") << 8 | s, n) for c, v in raw.items() if len(c) == k for s, n in v.items())
        tables.append((np.array([a for a, _ in own], np.int64), np.array([b for _, b in own], float)))
    trie = Trie(2, tables)
    for context in (b"ab", b"zz", b"za", bytes([PAD, PAD])):
        code = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256) if s != PAD])
        assert (10 ** trie.score(code)).sum() == pytest.approx(1)
    assert Scorer(2, tables)([b"abba"])[0] == pytest.approx(sum(walk(raw, c, s) for c, s in ((bytes([PAD, PAD]), 97), (bytes([PAD, 97]), 98), (b"ab", 98), (b"bb", 97), (b"ba", END))))


def test_odd_rows(odd_docs):
    rows = ppm_scores(odd_docs).collect()
    assert len(rows) == 13 and all(math.isfinite(r.score) and not (r.doc_id is None and r.held_out) for r in rows)
