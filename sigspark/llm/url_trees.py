"""URL verdicts: rules for hosts and paths, and gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs: those that a rule decides. Features are of the URL's letters
only: lengths, depth, digit ratio, entropy, parameter counts, and how often URLs with the same host
suffix are blocked among those learnt from.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, hashed_sample, read_table

BLOCK, ALLOW = "block", "allow"
#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))


@dataclass(frozen=True)
class Settings:
    """At most ``sample`` labelled rows are learnt from, the first in an order by hash, of URLs of ``longest`` characters at most."""

    sample: int = 20_000
    longest: int = 8_192
    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    least: int = 20
    folds: int = 5


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "query_length", "fragment", "secure", "www", "suffix_rate", "domain_rate")


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null; of equal lengths the last by name."""
    shape = "struct<length: int, rule: string, verdict: string>"
    hits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(F.lit(None).cast(shape), *hits)))


def suffixes_of(host: str) -> tuple[str, str]:
    """The last label of a host, and the last two."""
    labels = host.rsplit(".", 2)
    return labels[-1], ".".join(labels[-2:])


def entropy(text: str) -> float:
    counts = np.array(list(Counter(text).values()), float)
    share = counts / counts.sum() if len(counts) else np.ones(1)
    return float(-(share * np.log2(share)).sum())


def features(urls: list[str], hosts: list[str], paths: list[str], rates: tuple[dict, dict, float]) -> np.ndarray:
    top, domain, usual = rates
    out = np.zeros((len(urls), len(FEATURES)))
    for row, url, host, path in zip(out, urls, hosts, paths, strict=True):
        head, _, fragment = url.partition("#")
        query = head.partition("?")[2]
        last, two = suffixes_of(host)
        row[:] = (
            len(url), len(host), len(path), path.strip("/").count("/") + bool(path.strip("/")), host.count(".") + 1,
            sum(map(url.count, "0123456789")) / max(1, len(url)), host.count("-"), entropy(host), query.count("&") + bool(query), len(query),
            bool(fragment), url[:6].lower() == "https:", host.startswith("www."), top.get(last, usual), domain.get(two, usual),
        )
    return out


def rates_of(hosts: list[str], labels: np.ndarray) -> tuple[dict, dict, float]:
    """Smoothed shares of blocked URLs by the last label and the last two; no more entries than URLs learnt from."""
    usual = float(labels.mean()) if len(labels) else 0.0
    out = []
    for k in (0, 1):
        seen, bad = Counter(), Counter()
        for host, label in zip(hosts, labels, strict=True):
            key = suffixes_of(host)[k]
            seen[key] += 1
            bad[key] += int(label)
        out.append({s: (bad[s] + 10 * usual) / (n + 10) for s, n in seen.items()})
    return out[0], out[1], usual


class Trees:
    """Boosted regression trees for the logistic loss, grown level by level on binned features."""

    def __init__(self, settings: Settings):
        self.s, self.start, self.trees = settings, 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        s = self.s
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, s.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        score = np.full(len(y), self.start)
        for _ in range(s.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(s.depth):
                width = 1 << level
                best = np.zeros(width) + 1e-6
                pick = [(0, np.inf)] * width
                for f, edge in enumerate(edges):
                    if not len(edge):
                        continue
                    k = len(edge) + 1
                    at = node * k + binned[:, f]
                    sums = [np.bincount(at, v, width * k).reshape(width, k).cumsum(1) for v in (g, h, np.ones(len(y)))]
                    left = [v[:, :-1] for v in sums]
                    right = [v[:, -1:] - v[:, :-1] for v in sums]
                    gain = sum(a[0] ** 2 / (a[1] + 1) for a in (left, right)) - sums[0][:, -1:] ** 2 / (sums[1][:, -1:] + 1)
                    gain[(left[2] < s.least) | (right[2] < s.least)] = 0
                    for n in range(width):
                        if (i := int(gain[n].argmax())) is not None and gain[n, i] > best[n]:
                            best[n], pick[n] = gain[n, i], (f, float(edge[i]))
                tree.append(([f for f, _ in pick], [t for _, t in pick]))
                feature, cut = np.array(tree[-1][0]), np.array(tree[-1][1])
                node = node * 2 + (x[np.arange(len(y)), feature[node]] > cut[node])
            size = 1 << s.depth
            leaf = -s.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + 1)
            self.trees.append((tree, leaf))
            score += leaf[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, every = np.full(len(x), self.start), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = node * 2 + (x[every, np.array(feature)[node]] > np.array(cut)[node])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))


def learn(labelled: DataFrame, settings: Settings) -> tuple[Trees, tuple] | None:
    """Fit on (page_id, url, host, path, label) rows: a bounded sample of them."""
    rows = hashed_sample(labelled.filter(F.length("url") <= settings.longest), settings.sample, "url", "page_id").collect()
    if len({r.label for r in rows}) < 2:
        return None
    hosts, y = [r.host for r in rows], np.array([r.label == BLOCK for r in rows], float)
    fold = np.array([zlib.crc32(h.encode()) for h in hosts]) % settings.folds  # a host's URLs are in one fold
    x = np.zeros((len(rows), len(FEATURES)))
    for k in range(settings.folds):  # the labels of a URL's host aren't among those that its rates come from
        own, others = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        rates = rates_of([hosts[i] for i in others], y[others])
        x[own] = features([rows[i].url for i in own], [hosts[i] for i in own], [rows[i].path for i in own], rates)
    return Trees(settings).fit(x, y), rates_of(hosts, y)


def judge(pages: DataFrame, rules: tuple = RULES, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    The score is the trees' probability of block; it decides, from 0.5 on, where no rule fits. Null
    URLs and those without :// have an empty host and path; the trees judge them like any other.
    Where rules label no URL, or all alike, there is nothing to learn: the score is 0 and the verdict
    allow. Repeated rows and null ids are judged row by row; an empty table gives no row; other
    columns are ignored and never read.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    seen = seen.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    seen = seen.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    labelled = seen.filter("hit is not null").select("page_id", "url", "host", "path", F.col("hit.verdict").alias("label"))
    shared = pages.sparkSession.sparkContext.broadcast(learn(labelled, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, hosts, paths = (batch.column(i).to_pylist() for i in (1, 2, 3))
            score = np.zeros(len(urls))
            if shared.value and urls:
                trees, rates = shared.value
                score = trees.predict(features(urls, hosts, paths, rates))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 2, 3, 4, 5)), pa.array(score)], names=["page_id", "host", "path", "rule", "ruled", "score"]
            )

    flat = seen.select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    scored = flat.mapInArrow(run, "page_id long, host string, path string, rule string, ruled string, score double")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))
