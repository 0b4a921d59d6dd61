import duckdb
import numpy as np

from sigspark.llm.cover_tree import OP5_SQL, Settings, Tree, embedding_links, linked_pairs, nested_centres, op5_cover_tree

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, cosine=0.95):
    unit = {}
    for i, e in rows:
        ok = i is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)
        unit[len(unit)] = (i, np.array(e, float) / np.sqrt((np.array(e, float) ** 2).sum()) if ok else None)
    n = len(unit)
    link = [[unit[a][1] is not None and unit[b][1] is not None and a != b and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= cosine for b in range(n)] for a in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[a], *(root[b] for b in range(n) if link[a][b])], key=lambda k: (unit[k][0] is None, unit[k][0] or 0)) for a in range(n)]
        if new == root:
            break
        root = new
    return sorted(((unit[a][0], sum(link[a]), unit[root[a]][0], unit[a][0] == unit[root[a]][0]) for a in range(n)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def clusters(n, seed, dim=16):
    rng = np.random.default_rng(seed)
    hubs = rng.normal(size=(8, dim))
    rows = [hubs[rng.integers(8)] + rng.normal(size=dim) * rng.choice([0.05, 0.15, 0.3, 3]) for _ in range(n)]
    return [(int(i), [float(np.float32(v)) for v in r * rng.choice([0.01, 1, 50])]) for i, r in zip(rng.permutation(n), rows, strict=True)]


def test_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert got(op5_cover_tree(spark, folder)) == sorted(map(tuple, duck.sql(OP5_SQL).fetchall()), key=str)


def test_many_small_units(spark):
    rows = clusters(300, 1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    for s in (Settings(), Settings(unit=20), Settings(unit=40, fan=2, radii=(0.5,)), Settings(unit=10, fan=3, levels=2, sample=20), Settings(unit=60, fan=4, least=5, gain=-10.0), Settings(unit=400, least=20)):
        assert got(embedding_links(df, s)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]),
        (10, [1.0, 0.0, 0.0]), (11, [1e-30, 0.0]), (12, [3e38, 0.0]), (None, [1.0, 0.0]), (None, None), (13, [-1.0, 0.0]), (14, [1.0]),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert got(embedding_links(df)) == brute(rows)
    assert embedding_links(df.limit(0)).count() == 0


def test_dual_traversal():
    rng = np.random.default_rng(2)
    x = np.array([e for _, e in clusters(400, 3)])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = Settings()
    a, b = x[:250], x[250:]
    ta, tb = (Tree(y, nested_centres(y, s.radii)) for y in (a, b))
    pairs = {(int(p), int(q)) for ps, qs in linked_pairs(ta, tb, s) for p, q in zip(ps, qs, strict=True)}
    assert pairs == {(int(p), int(q)) for p, q in zip(*np.nonzero(a @ b.T >= s.cosine), strict=True)}
    own = [tuple(sorted((int(p), int(q)))) for ps, qs in linked_pairs(ta, None, s) for p, q in zip(ps, qs, strict=True)]
    want = {(int(p), int(q)) for p, q in zip(*np.nonzero(np.triu(a @ a.T >= s.cosine, 1)), strict=True)}
    assert len(own) == len(set(own)) and set(own) == want and rng is not None


def test_cells_that_link_as_they_are(spark):
    """A ball of many near vectors, another near it, and one apart: counts come from sums."""
    rng = np.random.default_rng(5)
    hubs = np.eye(8)[:3] + np.array([[0, 0.1, 0, 0, 0, 0, 0, 0], [0.95, -0.4, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0]])
    rows = [(i, [float(np.float32(v)) for v in hubs[i % 3 if i % 7 else 0] + rng.normal(size=8) * 0.01]) for i in range(240)]
    rows += [(1000 + i, e) for i, e in rows[:30]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    for s in (Settings(unit=12, fan=3), Settings(unit=12, fan=8, levels=1), Settings()):
        assert got(embedding_links(df, s)) == brute(rows)
