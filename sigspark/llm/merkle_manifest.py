"""Merkle manifest of a dataset, kept as an append log of nodes in postorder.

Leaves of a part stand in order of their ids; every two consecutive nodes, and a last one alone, become their hash,
until one is left. The roots of the parts are the leaves of the top tree. Nodes are logged in the order in which they
are completed: leaf ``e`` is preceded by ``2 * e - popcount(e)`` nodes (by subtree sizes), and the nodes that end in it
follow it upwards. So any node's position in the log is known from its level, its index and the number of leaves,
and siblings are addressed in the log without a search. Builders are aligned: each completes the subtree of 2^k
consecutive nodes, and the next round of builders takes their roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, numbered, read_table, scoped
from .sharding import CRC, CRC_TABLE

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, n long, level int, index long, pos long, hash binary"
#: The tree whose leaves are the roots of all others.
TOP = -1


def digest_of(*values: Column) -> Column:
    """Hash of values: each '-' if null, else its bytes in UTF-8, ':', and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def parent(children: bytes) -> bytes:
    return hashlib.sha256(children).hexdigest().encode()


def position(level: np.ndarray | int, index: np.ndarray, n: int) -> np.ndarray:
    """Where the log of a tree of ``n`` leaves has a node: behind all nodes that end before its last leaf, and those below it."""
    last = np.minimum((np.asarray(index, np.int64) + 1) << level, n) - 1
    return 2 * last - np.bitwise_count(last).astype(np.int64) + level


def position_column(level: Column, index: Column, n: Column) -> Column:
    last = F.least(F.call_function("shiftleft", index + 1, level), n) - 1
    return 2 * last - F.bit_count(last) + level


def aligned_builder(base: int, k: int) -> Callable[[pa.Table], pa.Table]:
    """Completes the subtree over up to 2^k consecutive nodes of level ``base`` of one tree; stops at the tree's root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        first, row = table.column("index")[0].as_py(), [h.hex().encode() for h in table.column("hash").to_pylist()]
        levels = {0: row} if base == 0 else {}
        for level in range(base, base + k):
            if (n - 1) >> level == 0:
                break
            row = [parent(b"".join(row[i : i + 2])) for i in range(0, len(row), 2)]
            levels[level + 1] = row
        level = np.repeat(list(levels), [len(r) for r in levels.values()]).astype(np.int32)
        index = np.concatenate([np.empty(0, np.int64), *((first >> (x - base)) + np.arange(len(r)) for x, r in levels.items())])
        pos = np.concatenate([np.empty(0, np.int64), *(position(x, (first >> (x - base)) + np.arange(len(r)), n) for x, r in levels.items())])
        hashes = pa.array([bytes.fromhex(h.decode()) for r in levels.values() for h in r], pa.binary())
        out = pa.table({"tree": pa.array(np.full(len(level), tree)), "n": pa.array(np.full(len(level), n)), "level": level, "index": index, "pos": pos, "hash": hashes})
        return out.take(np.argsort(pos, kind="stable"))  # order of completion

    return run


def logged(rows: DataFrame, largest: int, k: int) -> DataFrame:
    """Log of the trees over (tree, n, index, hash); the largest has ``largest`` leaves. A round of builders for every k levels."""
    below, base, parts = rows, 0, []
    while not parts or (largest - 1) >> base > 0:
        blocks = below.select("tree", "n", "index", "hash", F.shiftright("index", k).alias("block")).groupBy("tree", "block")
        parts.append(materialise(blocks.applyInArrow(aligned_builder(base, k), NODES)))
        base += k
        below = parts[-1].filter((F.col("level") == base) & (F.shiftright(F.col("n") - 1, base) > 0))
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log


def roots_of(log: DataFrame) -> DataFrame:
    """The node at which a tree's builders stopped."""
    return log.filter(F.expr("shiftright(n - 1, level) = 0")).select("tree", "hash")


@dataclass(frozen=True)
class Manifest:
    """``rows``: (tree, n, index, hash, own columns) of each leaf; ``log``: all nodes; ``parts``: (tree, part, n, first); ``root``: hex."""

    rows: DataFrame
    log: DataFrame
    parts: DataFrame
    root: str | None
    k: int


def build_manifest(leaves: DataFrame, k: int = 10) -> Manifest:
    """From (part, key, hash, own columns): parts ordered null first, then bytewise; leaves by key, null first, then hash.

    Tables are written below the shared folder. A hot part is dealt out by its blocks of 2^k leaves. An empty table has no root.
    """
    rows = numbered(leaves, F.col("part").asc_nulls_first(), F.col("key").asc_nulls_first(), "hash")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"))
    parts = materialise(numbered(parts, F.col("part").asc_nulls_first(), name="tree"))
    count, largest = parts.agg(F.count(F.lit(1)), F.max("n")).first()
    known = parts.withColumnRenamed("part", "of")
    rows = materialise(rows.join(known, F.col("part").eqNullSafe(F.col("of"))).withColumn("index", F.col("number") - F.col("first")).drop("of", "first", "number"))
    log = logged(rows, largest or 0, k)
    upper = logged(roots_of(log).select(F.lit(TOP).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("index"), "hash"), count, k)
    top = roots_of(upper).first()
    return Manifest(rows, log.unionByName(upper), parts, top.hash.hex() if top else None, k)


def addressed(nodes: DataFrame, log: DataFrame, low: Column) -> DataFrame:
    """Siblings of (tree, n, at, own columns), ``at`` being an index of level ``low``, on each level from there to the root:
    own columns, level, left, hash; the last two are null where a node stands alone. The log is met by position only."""
    levels = F.expr("length(bin(n - 1))") * F.when(F.col("n") > 1, 1).otherwise(0)
    steps = nodes.withColumn("low", low).withColumn("level", F.explode(F.filter(F.sequence(F.col("low"), F.greatest(F.col("low"), levels)), lambda x: x < levels)))
    sibling = F.call_function("shiftright", F.col("at"), F.col("level") - F.col("low")).bitwiseXOR(F.lit(1))
    there = sibling < F.call_function("shiftright", F.col("n") - 1, F.col("level")) + 1
    steps = steps.withColumn("pos", F.when(there, position_column(F.col("level"), sibling, F.col("n")))).withColumn("left", F.when(there, sibling % 2 == 0))
    return steps.join(log.select("tree", "pos", "hash"), ["tree", "pos"], "left")


def proofs(m: Manifest) -> DataFrame:
    """Per leaf its own columns, hash (hex), subroot (hex) and siblings: an array of (left, hash) from the leaf up to the root,
    one entry a level; both null where the node stands alone. No task holds more than a block of leaves and its stretch of the log."""
    k, own = m.k, [c for c in m.rows.columns if c not in ("tree", "n", "index", "hash", "part", "key")]
    high = materialise(m.log.filter(f"level >= {k} or tree = {TOP}"))
    entry = F.struct("level", "left", "hash")
    paths = lambda df, keys: df.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("path"))
    trees = m.parts.select(F.col("tree").alias("of"), F.lit(TOP).cast("long").alias("tree"), F.lit(m.parts.count()).cast("long").alias("n"), F.col("tree").alias("at"))
    over = paths(addressed(trees, high, F.lit(0)), ["of"]).withColumnsRenamed({"of": "tree", "path": "over"})
    blocks = m.rows.groupBy("tree", "n", F.shiftright("index", k).alias("block")).agg(F.count(F.lit(1)).alias("leaves"))
    inner = paths(addressed(blocks.select("tree", "n", "block", F.col("block").alias("at")), high, F.lit(k)), ["tree", "block"])
    subroots = roots_of(m.log.filter(f"tree <> {TOP}")).withColumnRenamed("hash", "subroot")
    both = blocks.join(inner, ["tree", "block"], "left").join(subroots, "tree").join(over, "tree", "left")
    empty = F.array().cast("array<struct<level:int,left:boolean,hash:binary>>")
    path = F.transform(F.concat(F.coalesce("path", empty), F.coalesce("over", empty)), lambda x: F.struct(x.left.alias("left"), x.hash.alias("hash")))
    stretch = m.log.filter(f"level <= {k} and tree <> {TOP}").select("tree", F.expr(f"shiftright(index, {k} - level)").alias("block"), "pos", "hash", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("array<struct<left:boolean,hash:binary>>").alias("path"))
    side = stretch.unionByName(both.select("tree", "block", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("hash"), "subroot", path.alias("path")))
    leaves = m.rows.select("tree", F.shiftright("index", k).alias("block"), "n", "index", "hash", *own)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        head = right.filter(pc.is_null(right.column("pos"))).select(["subroot", "path"]).to_pylist()[0]
        nodes = right.filter(pc.is_valid(right.column("pos"))).sort_by("pos")
        places, hashes = nodes.column("pos").to_numpy(), [h.hex() for h in nodes.column("hash").to_pylist()]
        n, index = left.column("n")[0].as_py(), left.column("index").to_numpy()
        local = min(k, (n - 1).bit_length())
        at, side = np.full((len(index), local + len(head["path"])), -1), np.zeros((len(index), local + len(head["path"])), bool)
        for level in range(local):
            sibling = (index >> level) ^ 1
            there = sibling <= (n - 1) >> level
            at[there, level] = np.searchsorted(places, position(level, sibling[there], n))
            side[:, level] = sibling % 2 == 0
        for step, x in enumerate(head["path"]):
            if x["hash"] is not None:
                at[:, local + step], side[:, local + step] = len(hashes), x["left"]
                hashes.append(x["hash"].hex())
        none = pa.array((at < 0).ravel())
        entries = pa.StructArray.from_arrays([pa.array(side.ravel(), mask=(at < 0).ravel()), pa.array(hashes, pa.string()).take(pc.if_else(none, None, pa.array(at.ravel())))], names=["left", "hash"])
        siblings = pa.ListArray.from_arrays(pa.array(np.arange(len(index) + 1) * at.shape[1], pa.int32()), entries)
        out = {c: left.column(c) for c in own}
        leaf = pa.array([h.hex() for h in left.column("hash").to_pylist()], pa.string())
        return pa.table({**out, "leaf": leaf, "subroot": pa.array([head["subroot"].hex()] * len(index), pa.string()), "siblings": siblings})

    kinds = dict(m.rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in own), "leaf string, subroot string, siblings array<struct<left: boolean, hash: string>>"])
    return leaves.groupBy("tree", "block").cogroup(side.groupBy("tree", "block")).applyInArrow(run, schema)


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    step = lambda h, s: F.sha2(F.when(s.hash.isNull(), h).when(s.left, F.concat(s.hash, h)).otherwise(F.concat(h, s.hash)), 256)
    return F.aggregate(siblings, leaf, step)


@scoped
def manifest(docs: DataFrame, tampered: Column | None = None, k: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` says which rows are verified with n_chars one higher (null n_chars stays). Parts are languages; null is a
    part of its own, the first. Within one, leaves go by doc_id (null ids first), then by their hash; rows equal in all
    five columns are leaves of their own with any of the places. An only leaf is its part's root. Null and empty texts
    differ. An empty table gives no row. Other columns are ignored.
    """
    fields = {c: F.col(c) for c in FIELDS}
    changed = F.when(F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False), digest_of(*({**fields, "n_chars": F.col("n_chars") + 1}.values())))
    leaves = docs.select(F.col("lang").alias("part"), F.col("doc_id").alias("key"), F.unhex(digest_of(*fields.values())).alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(changed).alias("changed"))
    m = build_manifest(leaves, k)
    out = proofs(m).withColumn("folded_root", folded(F.coalesce(F.lower(F.hex("changed")), F.col("leaf")), F.col("siblings")))
    root = F.lit(m.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(F.concat_ws("", F.transform("siblings", lambda s: s.hash)), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


def leaf_sql(n_chars: str) -> str:
    cells = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in cells) + ")"


def tree_sql(leaves: str) -> str:
    """All nodes of the trees over (t, n, i, h)."""
    return f"""SELECT t, n, n AS m, 0 AS level, i, h FROM {leaves}
      UNION ALL SELECT t, n, (m + 1) // 2 AS m, level + 1 AS level, i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {{name}} WHERE m > 1 GROUP BY t, n, m, level, i // 2"""


OP13_SQL = f"""
WITH RECURSIVE e AS ({CRC_TABLE}),
d AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, {leaf_sql("n_chars")} AS leaf,
             CASE WHEN {CRC.format(text="doc_id::VARCHAR")} % 7 = 0 THEN {leaf_sql("n_chars + 1")} END AS changed FROM documents, e),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
lower_nodes AS ({tree_sql("(SELECT t, n, i, leaf AS h FROM r)").format(name="lower_nodes")}),
subroots AS (SELECT t, h FROM lower_nodes WHERE m = 1),
upper_nodes AS ({tree_sql("(SELECT 0 AS t, count(*) OVER () AS n, t AS i, h FROM subroots)").format(name="upper_nodes")}),
steps AS (
    SELECT r.id, a.level, r.i >> a.level::INT AS own, b.h FROM r JOIN (SELECT DISTINCT t, level, m FROM lower_nodes WHERE m > 1) a USING (t)
    LEFT JOIN lower_nodes b ON b.t = r.t AND b.level = a.level AND b.i = xor(r.i >> a.level::INT, 1)
    UNION ALL
    SELECT r.id, 100 + a.level, r.t >> a.level::INT AS own, b.h FROM r CROSS JOIN (SELECT DISTINCT level FROM upper_nodes WHERE m > 1) a
    LEFT JOIN upper_nodes b ON b.level = a.level AND b.i = xor(r.t >> a.level::INT, 1)),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS step FROM steps),
f AS (
    SELECT id, 0 AS step, coalesce(changed, leaf) AS h FROM r
    UNION ALL
    SELECT f.id, f.step + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN own % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END) FROM f JOIN s ON s.id = f.id AND s.step = f.step + 1),
p AS (SELECT id, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof FROM s GROUP BY id)
SELECT r.doc_id, r.leaf, subroots.h AS subroot, top.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, z.folded_root, z.folded_root = top.h AS verified
FROM r JOIN subroots USING (t) CROSS JOIN (SELECT h FROM upper_nodes WHERE m = 1) top LEFT JOIN p ON p.id = r.id
JOIN (SELECT id, arg_max(h, step) AS folded_root FROM f GROUP BY id) z ON z.id = r.id
"""
