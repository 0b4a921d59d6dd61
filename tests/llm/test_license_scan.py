import random
import re

from sigspark.llm.license_scan import NOTICES, PHRASES, Scanner, errors_for, op4_license_scan, scan, words_of

SF = "/root/testdata/sf0.01"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    words = plain_words(text)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places)


def distances(a, b):
    """Least edits between ``a`` and any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_documents_against_words(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_license_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, places = base(texts[r.doc_id])
        starts = [p for p, _ in places]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
    assert any("gpl-3" in r.labels for r in rows)


def test_errors_are_found_within_the_bound():
    rnd, scanner = random.Random(5), Scanner(PHRASES, NOTICES)
    for notice, label in list(NOTICES.items()) * 6:
        k = rnd.randrange(errors_for(notice) + 1)
        letters = list(notice)
        for _ in range(k):  # inside words, so that the ends stay
            i = rnd.randrange(1, len(letters) - 1)
            if letters[i] != " ":
                letters[i] = rnd.choice(["", "q", letters[i] + "z"])
        text = f"alpha beta {''.join(letters)} gamma"
        assert distances(notice, text) <= k
        spans = [s for s in scanner(text.encode())[1] if s[1] == "fuzzy" and s[0] == label]
        assert spans and spans[0][2] == 2 and min(s[4] for s in spans) <= k


def test_clean_texts_stay_clean(make_docs):
    texts = ["the license of the version is free", "mit lizenz", "under the permit license", "general public", "apache version", "cc by sa"]
    assert all(not r.spans for r in scan(make_docs(list(enumerate(texts)))).collect())


def test_overlaps_and_odd_rows(odd_docs, make_docs):
    out = scan(make_docs([(1, "CC-BY-NC cc by nc; Under The MIT License!"), (2, "é under the mit license é")])).collect()
    exact = {r.doc_id: [(s.label, s.first_word, s.last_word) for s in r.spans if s.method == "exact"] for r in out}
    assert exact == {1: [("cc-by-nc", 0, 2), ("cc-by-nc", 3, 5), ("mit", 6, 9)], 2: [("mit", 1, 4)]}
    rows = scan(odd_docs).collect()
    assert len(rows) == 13 and {r.n_words for r in rows if r.doc_id in (1, 2, 3, 11)} == {0}
    assert scan(make_docs([])).count() == 0
    assert words_of("Ab, é-9".encode()) == " ab é 9 ".encode()


def least_edits(a, b, most):
    """Edit distance, or None over ``most``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = next_row(row, i, x, b)
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


def next_row(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def check_spans(text, scanner):
    """Every reported span is within its errors, and no stretch of words within the bound meets none."""
    words = words_of(text.encode())
    spaces = [i for i, b in enumerate(words) if b == 32]
    for notice, label in NOTICES.items():
        k, n = errors_for(notice), len(notice)
        own = Scanner({}, {notice: label}).fuzzy(words)
        for _, a, b, errors, _ in own:
            assert least_edits(notice.encode(), words[a:b], k) == errors
        taken = sorted((a, b) for _, a, b, _, _ in own)
        assert all(x[1] < y[0] for x, y in zip(taken, taken[1:], strict=False))
        for i in spaces:
            for j in spaces:
                if n - k <= j - i - 1 <= n + k and not any(a < j and i + 1 < b for a, b in taken):
                    assert least_edits(notice.encode(), words[i + 1 : j], k) is None, (notice, words[i:j])


def test_adjacent_notices_are_both_found():
    scanner = Scanner(PHRASES, NOTICES)
    spans = scanner(b"released undr the mit licnse released under the mit license")[1]
    assert [(s[2], s[3], s[4]) for s in spans if s[1] == "fuzzy"] == [(0, 4, 2), (5, 9, 0)]
    long = scanner(b"released undr the mit licnse " * 4000)[1]
    assert sum(s[1] == "fuzzy" for s in long) == 4000


def test_spans_against_all_stretches():
    rnd, scanner = random.Random(11), Scanner(PHRASES, NOTICES)
    for _ in range(12):
        parts = []
        for _ in range(6):
            letters = list(rnd.choice(list(NOTICES)))
            for _ in range(rnd.randrange(6)):
                i = rnd.randrange(len(letters))
                letters[i] = rnd.choice(["", "x", " ", letters[i] * 2])
            parts += ["".join(letters), rnd.choice(["", "and more", "license", "under the"])]
        check_spans(" ".join(parts), scanner)


def test_spans_of_documents_against_all_stretches(spark):
    scanner = Scanner(PHRASES, NOTICES)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("text like '%icens%' and length(text) < 2500").collect()]
    assert texts
    for text in texts:
        check_spans(text, scanner)
