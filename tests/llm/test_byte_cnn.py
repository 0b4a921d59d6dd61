import zlib

import numpy as np

from sigspark.llm.byte_cnn import BLOCK, Network, Settings, chunks_of, laid_out, learn, op3_byte_cnn, score_quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op3_byte_cnn(spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9 and np.mean(np.array(good) >= 0.3) > 0.95


def test_chunks_cover_every_block():
    s = Settings()
    texts = [b"", b"x" * 60, b"y" * 61, b"z" * 5000]
    raw, counts = laid_out(texts, s.width)
    assert counts.tolist() == [1, 1, 2, 79] and len(raw) == counts.sum() * BLOCK + s.width - 1
    first, last, each = chunks_of(counts, s)
    assert each.sum() == len(first) and sorted({b for a, z in zip(first, last, strict=True) for b in range(a, z)}) == list(range(counts.sum()))
    assert all(a < z for a, z in zip(first, last, strict=True))


def test_scores_against_plain_loops():
    s = Settings(filters=3, width=3)
    net = Network(s)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, n).tolist()) for n in (0, 1, 63, 700, 2000)]
    for text, p in zip(texts, net.predict(texts), strict=True):
        n = max(1, -(-(len(text) + 2) // BLOCK)) * BLOCK
        raw = b"\0\0" + text.ljust(n, b"\0")
        h = np.array([sum(net.filters[j][raw[i + j]] for j in range(3)) for i in range(n)])
        k = max(1, -(-(n // BLOCK - 1) // 7))
        chunks = np.array([np.maximum(h[i * 7 * BLOCK : (i * 7 + 8) * BLOCK].max(0) + net.shift, 0) for i in range(k)])
        z = np.concatenate([chunks.mean(0), chunks.max(0)]) @ net.out[:-1] + net.out[-1]
        assert np.isclose(p, 1 / (1 + np.exp(-z)), atol=1e-5)


def test_fits_on_whole_texts(spark, make_docs, monkeypatch):
    seen = []
    monkeypatch.setattr(Network, "fit", lambda self, texts, y: seen.append(sorted(texts)) or self)
    texts = {i: f"{i} ".ljust(3000 * (i % 9), "x") + "end" for i in range(40)}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    learn(make_docs(list(texts.items())), labels, Settings())
    assert seen[0] == sorted(t.encode() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5)
    learn(make_docs(list(texts.items())), labels, Settings(sample=30, stretch=3000))
    assert set(seen[1]) < set(seen[0]) and 66_000 < sum(map(len, seen[1])) <= 90_000


def test_gradients():
    s = Settings(filters=2, width=2, decay=0.0)
    net, rng = Network(s), np.random.default_rng(0)
    net.filters, net.shift, net.out = (p.astype(np.float64) for p in (net.filters, net.shift, net.out))
    texts, y = [bytes(rng.integers(97, 105, n).tolist()) for n in (50, 900)], np.array([1.0, 0.0])

    def loss():
        p = net.predict(texts)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for p, g in zip((net.filters, net.shift, net.out), net.gradients(texts, y), strict=True):
        for at in list(zip(*np.nonzero(np.abs(g) > 1e-4), strict=True))[:12]:
            keep, e = p[at], 1e-5
            p[at] = keep + e
            up = loss()
            p[at] = keep - e
            down = loss()
            p[at] = keep
            assert np.isclose((up - down) / (2 * e), g[at], rtol=1e-2, atol=1e-5)


def test_odd_rows(spark, odd_docs, make_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)] + [(1, None, 0), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = score_quality(odd_docs, labels, Settings(epochs=1)).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    none = score_quality(odd_docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    for kind in (0, 1):
        alike = score_quality(odd_docs, labels.filter(f"quality = {kind}")).collect()
        assert {(r.score, r.predicted) for r in alike} == {(float(kind), kind)}
    assert score_quality(make_docs([]), labels).count() == 0
