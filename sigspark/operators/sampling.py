"""Seeded samples, splits and replays. The order of a draw is md5 of seed and id, the same on every engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a draw key that tell the stretches of a group apart.
PREFIX = 3


def draw_key(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(i).cast("string") for i in ids]))


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rn") -> DataFrame:
    """Adds a rank from 1 within groups. Payload columns should be joined back afterwards: groups are few, and hot."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def drawn(df: DataFrame, by: list[str], seed: int, key: str) -> DataFrame:
    """Adds rn, each row's place from 1 in the draw of its group, and n, the group's size.

    In two levels, so that no task holds a group: ranks inside the stretches of a group whose draw keys begin alike,
    and the sizes of the stretches before, which are sums over ``16 ** PREFIX`` numbers a group.
    """
    rows = df.withColumn("draw", draw_key(seed, key)).withColumn("stretch", F.substring("draw", 1, PREFIX))
    inside = Window.partitionBy(*by, "stretch").orderBy("draw", key)
    sizes = rows.groupBy(*by, "stretch").agg(F.count(F.lit(1)).alias("size"))
    along = Window.partitionBy(*by)
    before = F.sum("size").over(along.orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    starts = sizes.select(*by, "stretch", before.alias("before"), F.sum("size").over(along).alias("n"))
    placed = rows.withColumn("rn", F.row_number().over(inside)).join(starts, [*by, "stretch"])
    return placed.withColumn("rn", F.col("before") + F.col("rn")).drop("draw", "stretch", "before")


def stratified_fraction(df: DataFrame, fraction: float, seed: int, by: str = "label_idx", key: str = "capture_id", *, up: bool = False) -> DataFrame:
    """Per class max(1, round(n * fraction)) rows (half to even), or the ceiling if ``up``; all rows from fraction 1 on."""
    if fraction <= 0:
        raise ValueError("fraction must be above 0")
    if fraction >= 1:
        return df
    want = F.col("n") * F.lit(fraction)
    quota = F.greatest(F.lit(1), (F.ceil(want) if up else F.bround(want)).cast("int"))
    chosen = drawn(df.select(key, by), [by], seed, key).filter(F.col("rn") <= quota)
    return df.join(chosen.select(key), key, "left_semi")


def capped(df: DataFrame, cap: int, by: list[str], key: str = "capture_id", seed: int | None = None) -> DataFrame:
    """At most ``cap`` rows of each group: in the order of a draw, or of arrival (by key) without a seed."""
    order = [key] if seed is None else [draw_key(seed, key), key]
    chosen = ranked(df.select(key, *by), by, order).filter(F.col("rn") <= cap)
    return df.join(chosen.select(key), key, "left_semi")


def held_out_quotas(counts: DataFrame, fraction: float, by: str) -> DataFrame:
    """(by, quota): the ceiling of fraction * total dealt out to classes by largest remainder."""
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.crossJoin(F.broadcast(total)).withColumn("want", F.ceil(F.col("total") * F.lit(fraction)) * F.col("n") / F.col("total"))
    rows = rows.withColumn("base", F.floor("want")).withColumn("left", F.col("want") - F.floor("want"))
    short = rows.agg((F.first(F.ceil(F.col("total") * F.lit(fraction))) - F.sum("base")).alias("short"))
    order = Window.orderBy(F.desc(F.round("left", 9)), F.col(by))
    return rows.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(short)).select(by, (F.col("base") + (F.col("place") <= F.col("short")).cast("int")).alias("quota"))


def held_out(df: DataFrame, fraction: float, seed: int, by: str, key: str) -> DataFrame:
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    rows = drawn(df, [by], seed, key).join(held_out_quotas(counts, fraction, by), by)
    return rows.withColumn("held", F.col("rn") <= F.col("quota")).drop("rn", "quota", "n")


def stratified_split(df: DataFrame, seed: int, test: float = 0.2, val: float = 0.2, by: str = "label_idx", key: str = "capture_id") -> DataFrame:
    """Adds split: test is a share of all rows, val a share of the rest; sizes are ceilings, classes keep their shares."""
    first = held_out(df.select(key, by), test, seed, by, key)
    rest = held_out(first.filter("not held").drop("held"), val, seed + 1, by, key)
    parts = first.filter("held").select(key, F.lit("test").alias("split")).unionByName(rest.select(key, F.when(F.col("held"), "val").otherwise("train").alias("split")))
    return df.join(parts, key)


def plain_split(df: DataFrame, seed: int, test: float = 0.2, key: str = "capture_id") -> DataFrame:
    """Adds split: the first ceil(n * test) rows of a draw over all rows are the test."""
    rows = drawn(df.select(key).withColumn("all_rows", F.lit(1)), ["all_rows"], seed, key)
    split = F.when(F.col("rn") <= F.ceil(F.col("n") * F.lit(test)), "test").otherwise("train")
    return df.join(rows.select(key, split.alias("split")), key)


def class_split(df: DataFrame, seed: int, train: float = 0.7, val: float = 0.15, by: str = "label_idx", key: str = "capture_id") -> DataFrame:
    """Adds split per class: under three rows all train; rounded shares (half to even), one row at least, else n-2, 1, 1."""
    n = F.col("n")
    n_train, n_val = (F.greatest(F.lit(1), F.bround(n * F.lit(f)).cast("int")) for f in (train, val))
    over = n_train + n_val >= n
    n_train, n_val = F.when(over, F.greatest(F.lit(1), n - 2)).otherwise(n_train), F.when(over, 1).otherwise(n_val)
    rows = drawn(df.select(key, by), [by], seed, key)
    split = F.when((n < 3) | (F.col("rn") <= n_train), "train").when(F.col("rn") <= n_train + n_val, "val").otherwise("test")
    return df.join(rows.select(key, split.alias("split")), key)


def view_split(df: DataFrame, views: int) -> DataFrame:
    """All rows in all splits, with disjoint numbers of views: train from 0, val from 100, test from 200."""
    splits = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(o).alias("base")) for s, o in (("train", 0), ("val", 100), ("test", 200))])
    rows = df.withColumn("s", F.explode(splits)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(views - 1))))
    return rows.withColumn("split", F.col("s.split")).withColumn("view_idx", F.col("s.base") + F.col("k")).drop("s", "k")


def balanced_replay(df: DataFrame, seed: int, target: int | None = None, by: str = "label_idx", key: str = "capture_id") -> DataFrame:
    """(by, replay_idx, key): ``target`` draws of each class (the largest class's size by default).

    Classes that are too small are drawn with replacement, the others without. Join payloads afterwards.
    """
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    if target is None:
        counts = counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("target"))))
    else:
        counts = counts.withColumn("target", F.lit(target))
    blocks = counts.withColumn("block", F.explode(F.expr("sequence(0, (cast(target as long) - 1) div 10000)")))
    draws = blocks.withColumn("replay_idx", F.explode(F.expr("sequence(cast(block * 10000 as int), cast(least(target, (block + 1) * 10000) as int) - 1)"))).drop("block")
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(by).cast("string"), F.col("replay_idx").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = draws.withColumn("rn", F.when(F.col("n") < F.col("target"), 1 + F.pmod(number, F.col("n"))).otherwise(F.col("replay_idx") + 1).cast("int"))
    return draws.drop("n").join(drawn(df.select(key, by), [by], seed, key).withColumn("rn", F.col("rn").cast("int")), [by, "rn"]).select(by, "replay_idx", key)


def balanced_down(df: DataFrame, seed: int, most: int | None = None, by: str = "label_idx", key: str = "capture_id") -> DataFrame:
    """Every class down to the size of the smallest, and to ``most`` at most."""
    least = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    bound = F.col("least") if most is None else F.least(F.col("least"), F.lit(most))
    chosen = drawn(df.select(key, by), [by], seed, key).crossJoin(F.broadcast(least)).filter(F.col("rn") <= bound)
    return df.join(chosen.select(key), key, "left_semi")


def sweep_selection(df: DataFrame, classes: list[str], per_class: int, seed: int, most: int | None = None, by: str = "class_name", key: str = "capture_id") -> DataFrame:
    """(place, by, key): per_class rows of each class, classes in order; topped up in turns, or cut, to ``most``.

    A class without rows is an error.
    """
    spark = df.sparkSession
    order = spark.createDataFrame(list(enumerate(classes)), f"class_pos int, {by} string")
    longest = per_class if most is None else max(per_class, most)  # literal, so that each task passes on so many of a class at most
    few = ranked(df.select(key, by).join(F.broadcast(order), by), [by], [draw_key(seed, key), key]).filter(F.col("rn") <= longest)
    later = F.col("rn") > per_class
    place = Window.orderBy(later, F.when(later, F.col("rn")).otherwise(0), "class_pos", "rn")
    out = few.withColumn("place", F.row_number().over(place) - 1)
    out = out if most is None else out.filter(F.col("place") < most)
    missing = order.join(df.select(by).distinct(), by, "left_anti").agg(F.count(F.lit(1)).alias("empty"))
    check = F.when(F.col("empty") > 0, F.raise_error(F.lit("a class has no rows")).cast("int")).otherwise(F.col("place"))
    return out.crossJoin(F.broadcast(missing)).select(check.alias("place"), by, key)


def union_all(*parts: DataFrame) -> DataFrame:
    """Appends tables whose columns differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
