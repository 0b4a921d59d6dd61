"""Near-duplicate documents: MinHash bands find candidates, odd sketches sift them, full sets confirm.

An odd sketch folds a document's MinHash samples into a bitmap of parities. The bits set in the XOR
of two bitmaps count the samples that differ, so that a population count estimates a high similarity
precisely. Bands propose pairs; the sketch drops those that are many standard deviations below the
threshold; the rest is decided on the full shingle sets. Buckets that many texts share only for some
common passage are split by the rare shingles of their members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise, mix64, read_table, scoped, text_bytes
from .components import components

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Shingles of ``width`` words; ``bands`` x ``rows`` MinHash samples; sketches of ``bits`` bits.

    A pair at the threshold shares no band with probability (1 - 0.75**4)**24 = 1.1e-4 at these
    figures, and its sketch is sifted out when over ``sigmas`` standard deviations off. What the leaders
    leave apart is compared pair by pair in buckets of ``most_together`` members at most, by rare shingles in others.
    """

    width: int = 5
    percent: int = 75
    bands: int = 24
    rows: int = 4
    bits: int = 512
    sigmas: float = 5.0
    rounds: int = 2
    most_together: int = 256

    @property
    def sharper(self) -> Plan:
        """Ten times the samples, for the pairs that no leader has decided; over 4 standard deviations
        (3e-5) off is rarer than a missed band."""
        return replace(self, bands=self.bands * 10, bits=self.bits * 8, sigmas=4.0)

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Bits that the XOR of two sketches may have for a pair at the threshold."""
        k, z, j = self.samples, self.bits, self.percent / 100
        tossed = 2 * k * (1 - j)
        mean = z / 2 * (1 - (1 - 2 / z) ** tossed)
        slope = math.exp(-2 * tossed / z)
        spread = math.sqrt((2 * math.sqrt(k * j * (1 - j)) * slope) ** 2 + 2 * tossed**2 / z)
        return math.ceil(mean + self.sigmas * spread)


class WordHashes(dict):
    """64-bit hashes of words, computed once each; emptied when it holds too many words."""

    MOST = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, as they follow from its words."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(w) - width + 1)
    take = min(width, len(w))
    with np.errstate(over="ignore"):
        h = np.full(n, take, np.uint64)
        for i in range(take):
            h = (h + w[i : i + n]) * MULTIPLIER
    return np.unique(mix64(h))


def permutations(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_11))
    a = rng.integers(1, 2**63, samples, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**63, samples, dtype=np.uint64)


def min_samples(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation (upper 32 bits of a * h + b), in slices of the set."""
    best = np.full(len(a), 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1024):
            x = a[:, None] * hashes[None, i : i + 1024]
            x += b[:, None]
            np.minimum(best, (x >> np.uint64(32)).astype(np.uint32).min(1), out=best)
    return best


def band_keys(samples: np.ndarray, plan: Plan) -> np.ndarray:
    """A 64-bit key for each band of each row of ``samples``; bands have different keys."""
    rows = samples.reshape(len(samples), plan.bands, plan.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, plan.bands + 1, dtype=np.uint64), rows.shape[:2]) * MULTIPLIER
        for r in range(plan.rows):
            h = mix64(h + rows[:, :, r])
    return h.view(np.int64)


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps, as rows of 64-bit words."""
    n, k = samples.shape
    if not n:
        return np.empty((0, bits // 64), np.int64)
    with np.errstate(over="ignore"):
        seeds = np.arange(1, k + 1, dtype=np.uint64) * MULTIPLIER
        at = (mix64(samples.astype(np.uint64) + seeds) % np.uint64(bits)).astype(np.int64)
    at += np.arange(n)[:, None] * bits
    odd = (np.bincount(at.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, bits // 64)


def list_column(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """One row per document: size and SHA-256 of its sorted set, band keys and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (a, b) = WordHashes(), permutations(plan.samples)
        for batch in batches:
            n = batch.num_rows
            samples = np.zeros((n, plan.samples), np.uint32)
            sizes, digests = [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                h = shingle_set(text, plan.width, words)
                if len(h):
                    samples[i] = min_samples(h, a, b)
                sizes.append(len(h))
                digests.append(hashlib.sha256(h.tobytes()).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 list_column(band_keys(samples, plan)), list_column(odd_sketches(samples, plan.bits))],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURE)


def full_sets(docs: DataFrame, ids: DataFrame, plan: Plan) -> DataFrame:
    """(id, n_shingles, shingles, sharp) of the wanted documents: whole sets of hashed shingles, and sharper sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (a, b), sharper = WordHashes(), permutations(plan.sharper.samples), plan.sharper
        for batch in batches:
            sets = [shingle_set(t, plan.width, words) for t in text_bytes(batch.column(1))]
            samples = np.stack([min_samples(s, a, b) for s in sets]) if sets else np.empty((0, len(a)), np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                 list_column(odd_sketches(samples, sharper.bits))],
                names=["id", "n_shingles", "shingles", "sharp"],
            )

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.hint("merge"), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id long, n_shingles long, shingles array<long>, sharp array<long>")


def sketch_bits(x: Column, y: Column, plan: Plan) -> Column:
    """Bits set in the XOR of two sketches."""
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, plan.bits // 64)), F.bit_count(x[0].bitwiseXOR(y[0])))


def may_link(plan: Plan, x: str, y: str) -> Column:
    """Sizes and sketches allow a similarity at the threshold."""
    nx, ny = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    sizes = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * plan.percent
    return sizes & (sketch_bits(F.col(f"{x}.sketch"), F.col(f"{y}.sketch"), plan) <= plan.most_bits)


def sifted(pairs: DataFrame, traits: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    x = traits.select(F.col("id").alias("a"), F.struct("n_shingles", "sketch").alias("x"))
    y = traits.select(F.col("id").alias("b"), F.struct("n_shingles", "sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").filter(may_link(plan, "x", "y")).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    )
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - shared
    return both.filter(shared * 100 >= union * plan.percent).select("a", "b")


def rare_shingles(sets: DataFrame, plan: Plan) -> DataFrame:
    """(id, n_shingles, component, token): the rarest shingles of each set, as many as a pair at the threshold must share one of.

    A set keeps at least ``percent`` of its shingles in common with another at the threshold. So of one shingle more
    than it may lack, in the same order for all, the two have one in common; in order of rarity passages that many
    texts share come last. Shingles of one set only meet nothing.
    """
    tokens = materialise(sets.select("id", "n_shingles", "component", F.explode("shingles").alias("token")))
    common = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"))
    ranked = tokens.join(common, "token", "left").select("id", "n_shingles", "component", F.struct(F.coalesce("sets", F.lit(1)).alias("sets"), "token").alias("t"))
    listed = ranked.groupBy("id", "n_shingles", "component").agg(F.array_sort(F.collect_list("t")).alias("t"))
    most = F.col("n_shingles") - F.ceil(F.col("n_shingles") * plan.percent / 100) + 1
    first = F.filter(F.slice("t", F.lit(1), most.cast("int")), lambda t: t.sets > 1)
    return listed.select("id", "n_shingles", "component", F.explode(first).alias("t")).select("id", "n_shingles", "component", "t.token")


def pairs_by_rare_shingles(rare: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of different components that share a rare shingle, and whose sizes allow a link."""
    x, y = rare.alias("x"), rare.alias("y")
    nx, ny = F.col("x.n_shingles"), F.col("y.n_shingles")
    fits = (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * plan.percent)
    return x.join(y, (F.col("x.token") == F.col("y.token")) & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


@scoped
def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with the same set are one class, and its smallest id stands for it. In each bucket of a
    band one member leads, and every other is held against it; those that don't link get another
    leader from among them. Members that are then in another component than most of their bucket are
    held against all of it, by sharper sketches, or, in large buckets, against those that they share a rare
    shingle with, which a pair at the threshold must: whichever makes fewer pairs. A pair that shares a band is thus decided unless its ends
    are already connected: no bucket is cut. Null, empty or
    blank texts have an empty set, link with nothing, and are their own component. Texts of under
    ``width`` words have one shingle. Doc_ids should be unique; rows that repeat an id share one
    answer, and rows with a null id get a null component and kept = true. An empty table gives no
    row. Other columns are ignored.
    """
    sig = materialise(signatures(docs, plan))
    same = ["digest", "n_shingles"]
    known = sig.filter("doc_id is not null and n_shingles > 0")
    classes = materialise(known.groupBy(*same).agg(F.min("doc_id").alias("id")))
    reps = materialise(
        known.join(classes.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "n_shingles", "bands", "sketch")
    )
    entries = reps.select("id", F.explode("bands").alias("bucket"))
    crowds = materialise(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = materialise(entries.join(crowds, "bucket").select("bucket", "n", "id"))
    traits = reps.select("id", "n_shingles", "sketch")
    sets = materialise(full_sets(docs, members.select(F.col("id").alias("doc_id")).distinct(), plan).dropDuplicates(["id"]))

    # The member with most company leads: in a family of copies that is most often their origin. What
    # doesn't link with its bucket's leader gets the next leader from among its own.
    company = materialise(members.groupBy("id").agg(F.sum("n").alias("company")))
    left = materialise(members.join(company, "id").select("bucket", "id", "company"))
    links, tried = None, None
    for k in range(plan.rounds):
        leads = left.groupBy("bucket").agg(F.max(F.struct("company", -F.col("id"))).alias("lead"), F.count(F.lit(1)).alias("n"))
        leads = materialise(leads.filter("n > 1").select("bucket", (-F.col("lead")["col2"]).alias("leader")))
        led = left.join(leads, "bucket").filter("id <> leader")
        pair = [F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")]
        pairs = led.select(*pair).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(sifted(pairs, traits, plan))
        right = materialise(confirmed(pairs, sets, plan))
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = right if links is None else links.unionByName(right)
        if k + 1 < plan.rounds:
            left = materialise(led.select("bucket", "id", "company", *pair).join(links, ["a", "b"], "left_anti").select("bucket", "id", "company"))
    found = materialise(components(links))

    # What is still apart from most of its bucket is held against all of the bucket, by sharper sketches.
    apart = materialise(members.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")))
    shares = apart.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = shares.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("size")).filter("kinds > 1")
    main = materialise(main.select("bucket", F.col("most.component").alias("main"), (F.col("size") > plan.most_together).alias("large"), ((F.col("size") - F.col("most.n")) * F.col("size").cast("double")).alias("pairs")))
    crowded = materialise(apart.join(main.filter("large").select("bucket"), "bucket", "left_semi").select("id", "component").distinct())
    crowded = crowded.join(sets.select("id", "n_shingles", "shingles"), "id")
    rare = materialise(rare_shingles(crowded, plan))
    several = rare.groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    several = materialise(several.select("token", "n"))  # shingles of one component only make no pairs
    meet = several.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    split = meet < (main.filter("large").agg(F.sum("pairs")).first()[0] or 0.0)
    if split:
        main = main.filter("not large")
    apart = apart.join(main, "bucket").join(sets.select("id", "n_shingles", "sharp"), "id").join(reps.select("id", "bands"), "id")
    apart = materialise(apart.select("bucket", "id", "component", "main", "n_shingles", F.col("sharp").alias("sketch"), "bands"))
    x = apart.filter("component <> main").alias("x")
    y = apart.alias("y")
    differ = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
    shared = F.filter(F.zip_with("x.bands", "y.bands", lambda a, b: F.when(a == b, a)), lambda v: v.isNotNull())
    once = F.get(shared, F.lit(0)) == F.col("x.bucket")  # a pair counts in the first bucket that it shares
    pairs = (
        x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & differ & may_link(plan.sharper, "x", "y") & once)
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    )
    sharp = sets.select("id", "n_shingles", F.col("sharp").alias("sketch"))
    if split:
        pairs = pairs.unionByName(sifted(pairs_by_rare_shingles(rare.join(several.select("token"), "token", "left_semi"), plan), sharp, plan.sharper)).distinct()
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(confirmed(materialise(pairs), sets, plan))
    found = components(links)
    named = classes.join(found, "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    joined = sig.select("doc_id", *same).join(named, same, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS low FROM documents
  UNION
  SELECT ways.b, reach.low FROM reach JOIN ways ON ways.a = reach.id
), low AS (SELECT id, min(low) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM low JOIN documents ON documents.doc_id = id LEFT JOIN n USING (doc_id)
"""
