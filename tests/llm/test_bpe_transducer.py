import hashlib
import random
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sigspark.llm.bpe_transducer import Encoder, Transducer, Vocabulary, default_vocabulary, digests, encode_documents
from sigspark.llm.common import ship_arrays


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(open(default_vocabulary(), encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_every_code_point(vocabulary, library):
    encoder = Encoder(vocabulary, Transducer.compile([]))
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    bad = []
    for k in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}{chr(c)}1 {chr(c)}" for c in points[k : k + 500])
        ours = [int.from_bytes(x[i : i + 4], "little") for x in encoder.encode([text]) for i in range(0, len(x), 4)]
        if ours != ids_of(library, text):
            bad.append(k)
    assert not bad


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([*"abé \n\t'st1290-.<|>中😀", "<|endoftext|>", " the", "aaaa"]), max_size=60))
def test_random_texts(vocabulary, library, parts):
    text = "".join(parts)
    encoder = Encoder(vocabulary, Transducer.compile([(b" the", vocabulary.merge(b" the"))]))
    (ids,) = encoder.encode([text])
    numbers = [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
    assert numbers == ids_of(library, text)
    assert encoder.decode(ids) == library.decode(numbers, skip_special_tokens=False) == text


def test_long_words(vocabulary, library):
    rnd = random.Random(1)
    for text in ("a" * 5000, "=" * 3000, " " * 700, "".join(rnd.choice("abcdefgh") for _ in range(4000)), "é" * 999):
        assert vocabulary.merge(text.encode()) == ids_of(library, text)


def test_words_that_step_together(vocabulary):
    rnd = random.Random(3)
    words = [bytes(rnd.choice(b"aeinrst \xc3\xa9") for _ in range(rnd.randrange(0, 60))) for _ in range(3000)] + [b"aaaaaaa", b"a", b""]
    assert [list(memoryview(x).cast("I")) for x in vocabulary.merge_many(words)] == [vocabulary.merge(w) for w in words]


def test_stretches_cut_like_whole_texts(vocabulary):
    rnd = random.Random(4)
    encoder = Encoder(vocabulary, Transducer.compile([]))
    encoder.known.most = encoder.merged.most = 5
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b1", " ", "  ", "\n", "\t ", "\x1c", "\u3000", "'s", "!", "<|endoftext|>", "<|endof", "é"]) for _ in range(rnd.randrange(25)))
        parts = vocabulary.cut.split(text)
        words = [w for p in parts for w in ([p] if p in vocabulary.special else vocabulary.pieces(p))]
        ids = [i for w in words for i in ([vocabulary.special[w]] if w in vocabulary.special else vocabulary.merge(w.encode()))]
        assert list(memoryview(encoder.encode([text, "x" * 70])[0]).cast("I")) == ids


def test_transducer_is_minimal_and_exact(spark):
    rnd = random.Random(2)
    words = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 7))) for _ in range(400)}
    entries = [(w, list(w)) for w in words]
    built = Transducer.compile(entries)
    loaded = Transducer(ship_arrays(spark, {f: getattr(built, f) for f in Transducer.FIELDS})())
    probes = [*words, b"", b"abcabcabc", b"d", *(w + b"a" for w in words)]
    for word, place in zip(probes, loaded.places(probes).tolist(), strict=True):
        assert (place >= 0) == (word in words)
        if place >= 0:
            assert loaded.ids[loaded.id_start[place] : loaded.id_start[place + 1]].tolist() == list(word)
    suffix = Transducer.compile([(p + b"ing", [1]) for p in (b"walk", b"talk", b"sing", b"bring")])
    tails = {w[i:] for w in words for i in range(len(w) + 1)}
    rights = {tuple(sorted(t[len(p) :] for t in words if t.startswith(p))) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(loaded.final) == len(rights) <= len(tails) + len(words)
    assert len(suffix.final) < sum(map(len, (b"walking", b"talking", b"singing", b"bringing")))


def test_documents(spark, documents, odd_docs, make_docs, library):
    for docs in (documents, odd_docs):
        texts = [r.text or "" for r in docs.select("text").collect()]
        want = []
        for t in texts:
            ids = ids_of(library, t)
            raw = b"".join(i.to_bytes(4, "little") for i in ids)
            back = library.decode(ids, skip_special_tokens=False).encode()
            want.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
        out = digests(encode_documents(docs, default_vocabulary()))
        assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(want)
    assert encode_documents(make_docs([]), default_vocabulary()).count() == 0
