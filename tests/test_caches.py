"""Checksums of files of any size, and the cache that writers share."""

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from sigspark.sources import frames as src
from sigspark.sources import tables as tab


def test_digests_of_large_and_oddly_named_files(spark, tmp_path):
    """Over two gigabytes, which no row could hold; folders whose names are no patterns."""
    top = tmp_path / "a+b (c)"
    (top / "sub dir").mkdir(parents=True)
    with (top / "large.bin").open("wb") as f:
        f.truncate((2 << 30) + 12345)  # takes no room on the disk
    (top / "sub dir/é x.bin").write_bytes(b"abc")
    (top / "other.bin").write_bytes(b"not asked for")
    found = hashlib.sha256()
    for _ in range(2 << 10):
        found.update(bytes(1 << 20))
    found.update(bytes(12345))
    want = {"large.bin": found.hexdigest(), "sub dir/é x.bin": hashlib.sha256(b"abc").hexdigest(), "missing": None}
    names = spark.createDataFrame([(n,) for n in [*want, "missing"]], "path string")
    for folder in (str(top), f"file://{top}", f"{top}/"):
        out = src.checksums(spark, names, folder).collect()
        assert len(out) == 4 and {r.path: r.sha256 for r in out} == want


@pytest.fixture
def keys(spark):
    return spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 4).alias("group"))


def plain(new):
    return new.select("k", (F.col("k") * 2).alias("v"))


def test_two_writers_at_once(spark, keys, tmp_path):
    """Both find nothing and add everything; each key has the rows of one of them."""
    path, both = str(tmp_path / "cache"), threading.Barrier(2)

    def compute(name):
        def run(new):
            both.wait(60)
            return new.select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"), F.lit(name).alias("writer"))

        return run

    threads = [threading.Thread(target=lambda n=n: tab.cached(keys, "k", path, compute(n)).count()) for n in "ab"]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    rows = tab.entries(spark, path, "k").collect()
    assert sorted((r.k, r.v) for r in rows) == [(k, v) for k in range(40) for v in (1, 2)]
    assert len({r.writer for r in rows}) == 1
    assert len(list((tmp_path / "cache").glob("_commit=*"))) == 2
    tab.cleaned(keys, "k", path)
    assert len(list((tmp_path / "cache").glob("_commit=*"))) == 1 and tab.entries(spark, path, "k").count() == 80


def test_killed_writer_leaves_nothing(spark, keys, tmp_path):
    path = str(tmp_path / "cache")

    def dies(new):
        return new.select("k", F.when(F.col("k") < 39, F.col("k") * 2).otherwise(F.raise_error("killed").cast("long")).alias("v"))

    with pytest.raises(Exception, match="killed"):
        tab.cached(keys, "k", path, dies)
    assert tab.entries(spark, path, "k") is None
    assert sorted(map(tuple, tab.cached(keys, "k", path, plain).collect())) == [(k, 2 * k) for k in range(40)]
    tab.cleaned(keys, "k", path)
    assert not list((tmp_path / "cache").glob(".staged*")) and tab.entries(spark, path, "k").count() == 40


def test_invalid_entries_are_computed_again(spark, keys, tmp_path):
    """One invalid row makes its key count as missing, valid rows beside it or not."""
    path, valid = str(tmp_path / "cache"), F.col("v") >= 0
    bad = lambda new: new.select("k", F.explode(F.when(F.col("k") == 7, F.array(F.lit(-1), F.lit(1))).when(F.col("k") == 8, F.array(F.lit(None).cast("int"))).otherwise(F.array(F.lit(5)))).alias("v"))
    assert tab.cached(keys, "k", path, bad, valid).count() == 38
    asked = []

    def again(new):
        asked.extend(r.k for r in new.select("k").collect())
        return new.select("k", F.lit(9).alias("v"))

    out = {(r.k, r.v) for r in tab.cached(keys, "k", path, again, valid).collect()}
    assert sorted(asked) == [7, 8] and out == {(k, 9 if k in (7, 8) else 5) for k in range(40)}


def test_changed_files_give_other_keys(spark, tmp_path):
    """A file of another size or time is computed anew, and its old entry goes with the next cleaning."""
    path = str(tmp_path / "cache")
    rows = [("a", 10, "2024-01-01 00:00:00"), ("b", 20, "2024-01-01 00:00:00")]
    files = lambda rows: tab.file_keys(spark.createDataFrame(rows, "path string, length long, modificationTime string"), F.lit("nfft=64"))
    compute = lambda new: new.select("key", "path", "length")
    tab.cached(files(rows), "key", path, compute).count()
    changed = [("a", 11, "2024-01-01 00:00:00"), ("b", 20, "2024-01-02 00:00:00")]
    assert sorted((r.path, r.length) for r in tab.cached(files(changed), "key", path, compute).collect()) == [("a", 11), ("b", 20)]
    assert tab.entries(spark, path, "key").count() == 4
    tab.cleaned(files(changed), "key", path)
    assert sorted((r.path, r.length) for r in tab.entries(spark, path, "key").collect()) == [("a", 11), ("b", 20)]
