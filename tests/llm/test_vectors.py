"""Vector search and near-duplicates against brute force."""

import math
from collections import Counter

import numpy as np

from bilatera.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id string, first int"


def rows(n=400, dim=24):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, dim))
    out = [(i, (centres[i % 6] + 0.4 * rng.standard_normal(dim)).astype(np.float32).tolist(), i % 3) for i in range(n)]
    for i in range(30):  # near copies in a chain, exact and scaled copies
        out.append((1000 + i, (np.array(out[i // 3][1]) * (1 + i % 2) + 0.05 * rng.standard_normal(dim)).astype(np.float32).tolist(), out[i // 3][2]))
    out += [(2000 + i, out[7][1], out[7][2]) for i in range(5)]
    nan, inf = float("nan"), float("inf")
    out += [(3000, None, 1), (3020, [0.0] * dim, 1), (3001, [nan] * dim, 1), (3040, [inf] + [1.0] * (dim - 1), 1), (3002, [1.0, None], 1),
            (3003, out[3][1], None), (3004, [], 2), (None, out[4][1], 1), (3005, [1.0, 2.0], 1), (3060, [2.0, 1.0], 1), (7, out[7][1], out[7][2]), (40, out[40][1], 2)]
    return [(*r, "c", "i", 1) for r in out]


def ok(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_search(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    good = [(i, np.array(v, np.float64)) for i, v, *_ in data if i is not None and ok(v)]
    want = {}
    for i, v in good:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v.tolist(), w.tolist())), j) for j, w in good if j != i and len(w) == len(v))
            want[i] = [(j, -s) for s, j in scored[:20]]
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == {i for i, v in want.items() if v}
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in v}) for i, v in want.items() if v)
    exact = {(i, j): s for i, v in want.items() for j, s in v}
    assert all(math.isclose(s, exact[i, j], rel_tol=1e-12) for i, v in got.items() for j, s in v if (i, j) in exact)
    assert hits >= 0.99 * sum(map(len, want.values()))
    assert all(len(got[i]) == len(v) for i, v in want.items() if v)
    assert ann.search(df.limit(0)).count() == 0


def test_bounds_prune_and_hold():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal(64)
    turned = x / np.linalg.norm(x, axis=1, keepdims=True) @ ann.rotation(64)
    own = np.abs(turned).sum(axis=1) / 8
    estimate = (np.where(turned > 0, 1, -1) @ (q @ ann.rotation(64))) * np.linalg.norm(x, axis=1) / own / 8
    bound = np.linalg.norm(x, axis=1) * np.linalg.norm(q) * ann.EPSILON * np.sqrt(1 - own**2) / own / math.sqrt(63)
    assert (np.abs(estimate - x @ q) <= bound).all()


def test_near_duplicates(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    part = [k for k, (i, v, label, *_) in enumerate(data) if i is not None and label is not None and ok(v)]

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))

    near = {k: [m for m in part if m != k and data[m][2] == data[k][2] and len(data[m][1]) == len(data[k][1]) and cosine(data[m][1], data[k][1]) >= 0.98] for k in part}
    want = Counter()
    for k, (i, *_) in enumerate(data):
        found, todo = {k}, [k]
        while todo:
            new = set(near.get(todo.pop(), ())) - found
            found |= new
            todo += new
        component = min((data[m][0] for m in found if data[m][0] is not None), default=None)
        want[repr((i, len(near.get(k, ())), component, i == component or i is None))] += 1
    got = Counter(repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_chance_of_a_miss():
    """Pairs at the threshold meet in some table."""
    unit = lambda v: v / np.linalg.norm(v)
    for seed in range(20):
        g = np.random.default_rng(seed)
        a, b = unit(g.standard_normal(64)), g.standard_normal(64)
        pair = np.stack([a, 0.98 * a + math.sqrt(1 - 0.98**2) * unit(b - (b @ a) * a)])
        h = embedding_dedup.table_hashes(pair, np.array([1, 1]))
        assert (h[0] == h[1]).any()
