import math
import struct
from collections import Counter, defaultdict

import xxhash

from sigspark.llm import mixing
from sigspark.llm.mixing import Settings, bisect_exponent, mix, repeated, word_count


def table(spark, rows):
    return spark.createDataFrame(rows, "source string, docs long, tokens long")


def check(rows, drawn, settings, exponent):
    """Brute force of budgets: whole passes, and a partial pass in the order of the draws."""
    tokens = {(i, s): n for i, s, n in rows}
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    z = sum(t**exponent for t in sizes.values())
    whole = settings.budget if settings.budget is not None else max(t ** (1 - exponent) for t in sizes.values()) * z
    by = defaultdict(list)
    for r in drawn:
        by[r.source, r.epoch].append(r)
        assert r.tokens == tokens[r.doc_id, r.source]
    for s, t in sizes.items():
        budget = round(whole * t**exponent / z)
        passes, rest = divmod(budget, t)
        docs = sorted(i for i, x, _ in rows if x == s)
        for e in range(passes):
            assert sorted(r.doc_id for r in by[s, e]) == docs
        last = sorted(by[s, passes], key=lambda r: (r.block, r.place))
        assert not by[s, passes + 1] and len({r.doc_id for r in last}) == len(last)
        got = sum(r.tokens for r in last)
        assert got >= min(rest, t) and (not last or got - last[-1].tokens < rest)


def test_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "source", word_count(documents.text)).collect()]
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(n == max(1, len((texts[i] or "").encode().split())) for i, _, n in rows)
    for settings in (Settings(), Settings(budget=50_000, block_docs=3), Settings(entropy=2.9, block_docs=5), Settings(most_repeats=1.0)):
        sizes = Counter()
        for _, s, n in rows:
            sizes[s] += n
        exponent = bisect_exponent(table(spark, [(s, 1, t) for s, t in sizes.items()]), settings)
        drawn = mix(documents, settings).collect()
        check(rows, drawn, settings, exponent)
        if settings.budget is None:
            assert {r.doc_id for r in drawn} == {i for i, *_ in rows}


def test_exponent(spark):
    sizes = [1000, 100, 10, 10]
    src = table(spark, [(str(i), 1, t) for i, t in enumerate(sizes)])
    assert abs(bisect_exponent(src, Settings(most_repeats=4)) - (1 - math.log(4) / math.log(100))) < 2e-6
    a = bisect_exponent(src, Settings(entropy=1.0))
    w = [t**a for t in sizes]
    assert abs(-sum(x / sum(w) * math.log(x / sum(w)) for x in w) - 1.0) < 1e-4
    assert bisect_exponent(src, Settings(most_repeats=1)) == 1.0
    assert bisect_exponent(src, Settings(most_repeats=1e9)) == 0.0


def test_odd_rows(odd_docs, make_docs):
    drawn = mix(odd_docs).collect()
    assert len(drawn) == 13 and {r.source for r in drawn} == {""}
    assert mix(make_docs([])).count() == 0
    docs = make_docs([(1, "a b c", None, "x"), (2, "d", None, "y"), (3, None, None, None), (None, "e", None, "x")])
    out = repeated(docs)
    assert out.columns == docs.columns
    assert set(Counter(r.doc_id for r in out.collect())) == {1, 2, 3, None}


def chained(*parts):
    """The 64-bit hash of numbers one after the other, each seeded by the one before: (format, value) pairs."""
    seed = 42
    for kind, value in parts:
        seed = xxhash.xxh64_intdigest(struct.pack(kind, value), seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def bisected(sizes, most):
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if (max(sizes) / min(sizes)) ** (1 - middle) <= most else (middle, high)
    return high


def test_exponent_and_order_of_draws(documents, monkeypatch):
    """The exponent by halving, blocks and places by an own hash, and the last pass along them, over runs of two blocks."""
    monkeypatch.setattr(mixing, "RUN", 2)
    settings = Settings(most_repeats=1.7, block_docs=4)
    rows = [tuple(r) for r in documents.select("doc_id", "source", word_count(documents.text)).collect()]
    sizes, docs = Counter(), defaultdict(list)
    for i, s, n in rows:
        sizes[s] += n
        docs[s].append((i, n))
    exponent = bisected(sizes.values(), 1.7)
    whole = max(t ** (1 - exponent) for t in sizes.values()) * sum(t**exponent for t in sizes.values())
    want = set()
    for s, own in docs.items():
        blocks = -(-len(own) // 4)
        budget = whole * sizes[s] ** exponent / sum(t**exponent for t in sizes.values())
        passes, used = int(budget // sizes[s]), 0
        for epoch in range(passes + 1):
            order = sorted((chained(("<q", i), ("<i", 7), ("<i", epoch)) % blocks, chained(("<i", epoch), ("<i", 7), ("<q", i)), i, n) for i, n in own)
            for block, _, i, n in order:
                if epoch < passes or used < budget % sizes[s] - 0.5:
                    want.add((i, s, epoch, block))
                used += n if epoch == passes else 0
    drawn = mix(documents, settings).collect()
    assert {(r.doc_id, r.source, r.epoch, r.block) for r in drawn} == want and len(drawn) == len(want)


def test_null_ids_are_dealt_out(spark, make_docs):
    """Rows without an id, and rows of one id, come once each, in blocks of about the wanted size."""
    rows = [(None, "a b", "en", "s")] * 600 + [(1, "a b", "en", "s")] * 600 + [(i + 2, "a b", "en", "s") for i in range(600)]
    out = mix(make_docs(rows), Settings(block_docs=100)).collect()
    assert len(out) == 1800 and Counter(r.doc_id for r in out)[None] == 600
    assert max(Counter((r.epoch, r.block) for r in out).values()) < 200


def test_rows_come_as_often_as_they_are_drawn(make_docs):
    """By the plan of blocks, and by counting the draws; budgets whose partial pass ends in, before and behind blocks."""
    rows = [(i, "a b c " * (i % 5 + 1), "en", ["big", "small", None, "tiny"][0 if i % 9 else i % 4]) for i in range(700)]
    for settings in (Settings(block_docs=20), Settings(block_docs=1000), Settings(entropy=1.0, block_docs=7), Settings(budget=900, block_docs=10), Settings(budget=40_000, most_repeats=5.0, block_docs=50)):
        want = Counter(r.doc_id for r in mix(make_docs(rows), settings).collect())
        assert Counter(r.doc_id for r in repeated(make_docs(rows), settings).collect()) == want
