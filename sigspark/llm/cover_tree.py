"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

On the unit sphere a cosine of at least c is a distance of at most sqrt(2 - 2c). The upper levels of the
tree are cells in tables: a cell that holds too many vectors is split by pivots, farthest first, from a
bounded sample of its own; every vector goes to the nearest one. Cells below that are units, and each unit
gets nested levels of nodes whose radii halve. Two cells, and then two nodes, are compared only if their
centres are no farther apart than their covering radii and the threshold together. Cells that lie wholly
within the threshold of each other link as they are, with no pair expanded; what remains at the leaves is
decided in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, scoped
from .components import components

#: Added to every bound on distances of single precision.
SLACK = 1e-3
#: Comparisons that take as long as sending a vector to another task.
SENT = 500


@dataclass(frozen=True)
class Settings:
    """A cell of over ``unit`` vectors is split by up to ``fan`` pivots out of ``sample`` of its vectors, the first in an
    order by hash, unless all its vectors are within the threshold. After ``levels`` splits a cell is dealt into units by hash.
    Cells of over ``least`` vectors are split further as long as that saves a share of ``gain`` of the work: with separate
    clusters it does, as ever fewer pairs of cells are near; without structure it doesn't.
    """

    cosine: float = 0.95
    unit: int = 4096
    sample: int = 1024
    fan: int = 64
    levels: int = 9
    least: int = 256
    gain: float = 0.3
    radii: tuple[float, ...] = (0.8, 0.4, 0.2)

    @property
    def reach(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length, at unit length in double precision."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Rows that cover the others in ever smaller balls."""
    chosen, near = [0], distance(x @ x[0])
    while len(chosen) < min(most, len(x)):
        far = int(near.argmax())
        if near[far] <= SLACK:
            break
        chosen.append(far)
        near = np.minimum(near, distance(x @ x[far]))
    return x[chosen]


def nested_centres(x: np.ndarray, radii: tuple[float, ...]) -> np.ndarray:
    """Row x level: the number of the row that is the centre of the row's node of each radius."""
    near = x.astype(np.float32)
    out = np.zeros((len(x), len(radii)), np.int64)

    def split(rows: np.ndarray, level: int) -> None:
        if level == len(radii):
            return
        if len(rows) == 1:
            out[rows[0], level:] = rows[0]
            return
        close = near[rows] @ near[rows].T >= 1 - radii[level] ** 2 / 2
        free = np.ones(len(rows), bool)
        for i in range(len(rows)):
            if free[i]:
                own = np.flatnonzero(close[i] & free)
                own = own if i in own else np.append(own, i)
                free[own] = False
                out[rows[own], level] = rows[i]
                split(rows[own], level + 1)

    if len(x):
        split(np.arange(len(x)), 0)
    return out


class Tree:
    """Nodes of a unit by level: centre, radius, and children; the last level's children are points."""

    def __init__(self, x: np.ndarray, centres: np.ndarray):
        self.x, self.near = x, x.astype(np.float32)
        order = np.lexsort(centres.T[::-1])
        path = centres[order]
        self.points = order
        self.levels = []  # centre rows, radii, first child and number of children in the next level
        starts = []
        for k in range(centres.shape[1]):
            new = np.concatenate([[True], (path[1:, : k + 1] != path[:-1, : k + 1]).any(1)]) if len(order) else np.empty(0, bool)
            starts.append(np.flatnonzero(new))
        for k, at in enumerate(starts):
            centre = path[at, k]
            away = distance(np.einsum("ij,ij->i", self.near[order], self.near[path[:, k]]))
            radius = np.maximum.reduceat(away, at) if len(at) else np.empty(0)
            below = starts[k + 1] if k + 1 < len(starts) else np.arange(len(order))
            first = np.searchsorted(below, at)
            self.levels.append((centre, radius, first, np.diff(np.concatenate([first, [len(below)]]))))


def grid(first_a, n_a, first_b, n_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the pairs of nodes, in one array each."""
    size = n_a * n_b
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(n_b, size)
    return np.repeat(first_a, size) + place // wide, np.repeat(first_b, size) + place % wide


def dots(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 100_000) -> np.ndarray:
    out = np.empty(len(i), x.dtype)
    for k in range(0, len(i), step):
        out[k : k + step] = np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]])
    return out


def linked_pairs(a: Tree, b: Tree | None, s: Settings):
    """Yields arrays (row of a, row of b) of all pairs of two trees, or of two rows of one, that link."""
    same, b = b is None, b or a
    reach = s.reach + SLACK
    (ca, ra, fa, na), (cb, rb, fb, nb) = a.levels[0], b.levels[0]
    step = 2048
    for k in range(0, len(ca), step):
        near = distance(a.near[ca[k : k + step]] @ b.near[cb].T) <= ra[k : k + step, None] + rb + reach
        i, j = np.nonzero(near)
        i += k
        if same:
            i, j = i[i <= j], j[i <= j]
        yield from descend(a, b, 0, i, j, same, s, reach)


def descend(a: Tree, b: Tree, level: int, i: np.ndarray, j: np.ndarray, same: bool, s: Settings, reach: float):
    """Children of the node pairs (i, j) of a level, in parts of bounded size."""
    (_, _, fa, na), (_, _, fb, nb) = a.levels[level], b.levels[level]
    size = np.cumsum(na[i] * nb[j])
    at = 0
    while at < len(i):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 400_000, side="right")))
        p, q = grid(fa[i[at:end]], na[i[at:end]], fb[j[at:end]], nb[j[at:end]])
        if same:
            p, q = p[p <= q], q[p <= q]
        at = end
        if level + 1 < len(a.levels):
            (cp, rp, *_), (cq, rq, *_) = a.levels[level + 1], b.levels[level + 1]
            near = distance(dots(a.near, b.near, cp[p], cq[q])) <= rp[p] + rq[q] + reach
            yield from descend(a, b, level + 1, p[near], q[near], same, s, reach)
        else:
            if same:
                p, q = p[p < q], q[p < q]
            p, q = a.points[p], b.points[q]
            good = dots(a.x, b.x, p, q) >= s.cosine
            yield p[good], q[good]


def forest(n: int, p: np.ndarray, q: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest rows that links lead to, starting from earlier labels."""
    while len(p):
        low = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        np.minimum.at(label, before, label)  # the label's own row goes along
        label = label[label]
        if (label == before).all():
            break
    return label


def compare(table: pa.Table, s: Settings) -> pa.Table:
    """Links within one unit, or between two: counts of each vector, and links that connect the same."""
    unit = np.unique(np.array(table.column("unit").to_pylist()), return_inverse=True)[1]
    ids = table.column("id").to_numpy()
    order = np.lexsort((ids, unit))
    table, unit, ids = table.take(order), unit[order], ids[order]
    x = matrix(table.column("embedding"))
    copies = table.column("copies").to_numpy()
    centre_ids = np.stack([table.column(f"c{k}").to_numpy() for k in range(len(s.radii))], 1)
    parts, at = [], 0
    for u in np.unique(unit):
        n = int((unit == u).sum())
        rows = slice(at, at + n)
        parts.append((Tree(x[rows], np.searchsorted(ids[rows], centre_ids[rows])), at))
        at += n
    n, links, label = len(ids), np.zeros(len(ids), np.int64), np.arange(len(ids))
    both = table.column("first")[0].as_py() != table.column("second")[0].as_py()
    if not both or len(parts) == 2:
        (a, start_a), (b, start_b) = parts[0], parts[-1]
        for p, q in linked_pairs(a, b if both else None, s):
            p, q = p + start_a, q + start_b
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            label = forest(n, p, q, label)
    own, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
    return pa.table({
        "id": np.concatenate([ids[own], ids[moved]]), "links": np.concatenate([links[own], np.zeros(len(moved), np.int64)]),
        "other": pa.array(np.concatenate([np.zeros(len(own), np.int64), ids[label[moved]]]), mask=np.arange(len(own) + len(moved)) < len(own)),
    })


def pivots_of(table: pa.Table, s: Settings) -> pa.Table:
    """(cell, child, pivot) of a cell from a sample of its vectors. Children are numbered so that no two cells of any level are alike."""
    cell, n = table.column("cell")[0].as_py(), table.column("n")[0].as_py()
    table = table.sort_by([("rank", "ascending"), ("id", "ascending")]).slice(0, s.sample)
    found = farthest_first(matrix(table.column("embedding")), min(s.fan, max(2, -(-n // s.unit))))
    return pa.table({"cell": pa.array([cell] * len(found), pa.int64()), "child": pa.array([cell * s.fan + k + 1 for k in range(len(found))], pa.int64()), "pivot": pa.array(list(found), pa.list_(pa.float64()))})


def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's nearest pivot, from rows in order: a part's pivots come before its vectors, and only they are held."""
    part, pivots, children = None, [], []
    for batch in batches:
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.empty(0, np.int64)
        for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            rows, own = batch.slice(at, end - at), tuple(keys[at, :2].tolist())
            if own != part:
                part, pivots, children = own, [], []
            if keys[at, 2] == 0:
                pivots.append(matrix(rows.column("embedding")))
                children.append(rows.column("child").to_numpy())
                continue
            away = distance(matrix(rows.column("embedding")) @ np.concatenate(pivots).T)
            near = away.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("embedding"), rows.column("copies"), pa.array(np.concatenate(children)[near]), pa.array(away[np.arange(len(near)), near])],
                names=["id", "embedding", "copies", "cell", "away"],
            )


def split_cells(rows: DataFrame, large: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Vectors of the cells (cell, n) in their new cells, and these: (cell, parent, pivot, radius, n). Hot cells are dealt out in salted parts."""
    moved = rows.join(large, "cell")
    share = F.lit(s.sample + 8 * s.sample**0.5 + 10) / F.col("n")  # the part of the hash's range that holds a few more than the sample
    rank = F.xxhash64("id")
    sample = moved.filter(rank < (share - 0.5) * F.lit(2.0**64)).select("cell", "n", "id", "embedding", rank.alias("rank"))
    pivots = materialise(sample.groupBy("cell").applyInArrow(lambda t: pivots_of(t, s), "cell long, child long, pivot array<double>"))
    parts = F.ceil(F.col("n") / (8 * s.unit))
    heads = pivots.join(large, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    none = F.lit(None).cast("long")
    heads = heads.select("cell", "salt", F.lit(0).alias("kind"), none.alias("id"), none.alias("copies"), F.col("pivot").alias("embedding"), "child")
    data = moved.select("cell", F.pmod(F.xxhash64("id", F.lit(5)), parts).alias("salt"), F.lit(1).alias("kind"), "id", "copies", "embedding", none.alias("child"))
    both = heads.unionByName(data).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    placed = materialise(both.mapInArrow(assign, "id long, embedding array<double>, copies long, cell long, away double"))
    kids = placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    cells = kids.join(pivots.select(F.col("child").alias("cell"), F.col("cell").alias("parent"), "pivot"), "cell")
    return placed.drop("away"), cells.select("cell", "parent", "pivot", "radius", "n")


def near_cells(pairs: DataFrame, cells: DataFrame, s: Settings) -> DataFrame:
    """(first, second, inside) of the cells below near cells that are near themselves; ``inside``: all their vectors link."""
    x, y = (cells.select(F.struct("cell", "pivot", "radius").alias(c), F.col("parent").alias(f"{c}_parent")) for c in ("x", "y"))
    both = pairs.select("first", "second").join(x, F.col("first") == F.col("x_parent")).join(y, F.col("second") == F.col("y_parent"))
    both = both.filter((F.col("first") != F.col("second")) | (F.col("x.cell") <= F.col("y.cell")))
    dot = F.aggregate(F.zip_with("x.pivot", "y.pivot", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    apart = F.when(F.col("x.cell") == F.col("y.cell"), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)))
    both = both.withColumn("apart", apart).withColumn("wide", F.col("x.radius") + F.col("y.radius"))
    near = both.filter(F.col("apart") <= F.col("wide") + s.reach + SLACK)
    return near.select(F.least("x.cell", "y.cell").alias("first"), F.greatest("x.cell", "y.cell").alias("second"), (F.col("apart") + F.col("wide") + SLACK <= s.reach).alias("inside"))


def whole_links(placed: DataFrame, inside: DataFrame) -> DataFrame:
    """(id, links, other) rows of the pairs of cells whose vectors all link, from sums per cell."""
    sums = placed.groupBy("cell").agg(F.sum("copies").alias("weight"), F.min("id").alias("low"))
    x, y = (sums.select(F.col("cell").alias(c), F.col("weight").alias(f"{c}_weight"), F.col("low").alias(f"{c}_low")) for c in ("first", "second"))
    both = materialise(inside.join(x, "first").join(y, "second"))
    own = F.col("first") == F.col("second")
    sides = both.select(F.col("first").alias("cell"), F.col("second_weight").alias("gain"), own.cast("long").alias("own")).unionByName(
        both.filter(~own).select(F.col("second").alias("cell"), F.col("first_weight").alias("gain"), F.lit(0).cast("long").alias("own"))
    )
    gains = sides.groupBy("cell").agg(F.sum("gain").alias("gain"), F.max("own").alias("own")).join(sums.select("cell", "low"), "cell")
    each = placed.join(gains, "cell").select("id", (F.col("gain") - F.col("own") * F.col("copies")).alias("links"), F.col("low").alias("other"))
    return each.unionByName(both.filter(~own).select(F.col("first_low").alias("id"), F.lit(0).cast("long").alias("links"), F.col("second_low").alias("other")))


def work(cells: DataFrame, pairs: DataFrame) -> float:
    """What comparing the pairs of cells takes: pairs of vectors, and vectors sent, which count as SENT pairs each."""
    x, y = (cells.select(F.col("cell").alias(c), F.col("n").cast("double").alias(f"{c}_n")) for c in ("first", "second"))
    both = pairs.filter("not inside").join(x, "first").join(y, "second")
    return both.agg(F.sum(F.col("first_n") * F.col("second_n") + SENT * (F.col("first_n") + F.col("second_n")))).first()[0] or 0.0


def links_of(reps: DataFrame, s: Settings) -> DataFrame:
    """(id, links, other) rows: partial counts, and links that connect the same vectors as all links."""
    spark, n = reps.sparkSession, reps.count()
    if not n:
        return spark.createDataFrame([], "id long, links long, other long")
    cells = spark.createDataFrame([(0, 0, [], 2.0, n)], "cell long, parent long, pivot array<double>, radius double, n long")
    pairs = spark.createDataFrame([(0, 0, False)], "first long, second long, inside boolean")
    placed, cost, most = reps.withColumn("cell", F.lit(0).cast("long")), math.inf, s.unit
    for _ in range(s.levels):
        too_large = (F.col("n") > most) & (2 * F.col("radius") + SLACK > s.reach)
        large = cells.filter(too_large).select("cell", "n")
        if large.isEmpty():
            if most == s.least:
                break
            most, cost = s.least, work(cells, pairs)
            continue
        rows, new = split_cells(placed, large, replace(s, unit=most))
        finer = materialise(cells.filter(~too_large).withColumn("parent", F.col("cell")).unionByName(new))
        nearer = materialise(near_cells(pairs, finer, s))
        if most == s.least:
            before, cost = cost, work(finer, nearer)
            if cost > (1 - s.gain) * before:
                break
        cells, pairs = finer, nearer
        placed = materialise(placed.join(large.select("cell"), "cell", "left_anti").select(*rows.columns).unionByName(rows))

    rest = pairs.filter("not inside")
    parts = cells.select("cell", F.ceil(F.col("n") / s.unit).alias("parts"))
    wanted = rest.select(F.explode(F.array("first", "second")).alias("cell")).distinct().join(parts, "cell")
    dealt = placed.join(wanted, "cell").withColumn("unit", F.concat_ws(":", "cell", F.pmod(F.xxhash64("id"), F.col("parts"))))
    levels = ", ".join(f"c{k} long" for k in range(len(s.radii)))

    def centres(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        out = ids[nested_centres(matrix(table.column("embedding")), s.radii)]
        for k in range(len(s.radii)):
            table = table.append_column(f"c{k}", pa.array(out[:, k]))
        return table

    kept = dealt.select("id", "embedding", "copies", "cell", "unit")
    trees = materialise(kept.groupBy("unit").applyInArrow(centres, f"id long, embedding array<double>, copies long, cell long, unit string, {levels}"))
    others = rest.select(F.col("first").alias("cell"), F.col("second").alias("with_cell")).unionByName(rest.filter("first <> second").select(F.col("second").alias("cell"), F.col("first").alias("with_cell")))
    others = others.join(parts.withColumnRenamed("cell", "with_cell"), "with_cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = trees.join(others.select("cell", F.concat_ws(":", "with_cell", "part").alias("with")), "cell").drop("cell")
    met = met.withColumn("first", F.least("unit", "with")).withColumn("second", F.greatest("unit", "with")).drop("with")
    found = met.groupBy("first", "second").applyInArrow(lambda t: compare(t, s), "id long, links long, other long")
    return found.unionByName(whole_links(placed, pairs.filter("inside").select("first", "second")))


@scoped
def embedding_links(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null or empty, hold nulls or non-finite numbers, or are zero link with nothing, and so
    do rows without an id; their component is their own id. Vectors of different lengths never link.
    Equal vectors are one class with a count, whose smallest id stands for it; each counts as linked
    with the others. Repeated ids count row by row. An empty table gives no row; other columns are
    ignored. Labels aren't read.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    top = F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound & (top > 0), F.lit(False))
    rows = materialise(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, x).alias("embedding")))
    known = rows.filter("embedding is not null")
    classes = materialise(known.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    sizes = [r.n for r in classes.select(F.size("embedding").alias("n")).distinct().collect()]
    found = None
    for size in sorted(sizes):
        part = links_of(classes.filter(F.size("embedding") == size).select("id", "embedding", "copies"), s)
        found = part if found is None else found.unionByName(part)
    if found is None:
        named = classes.select("embedding", (F.col("copies") - 1).alias("n_links"), F.col("id").alias("component_id"))
    else:
        found = materialise(found)
        counts = found.groupBy("id").agg(F.sum("links").alias("links"))
        joined = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
        named = classes.join(counts, "id", "left").join(joined, "id", "left").select(
            "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
        )
    named = materialise(named)
    out = known.join(named, "embedding").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read_table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), n AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= 0.95
), reach AS (
  SELECT vec_id AS id, vec_id AS low FROM n
  UNION
  SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.id
), low AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = n.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM n JOIN low ON low.id = n.vec_id
"""
