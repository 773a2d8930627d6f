import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import one_bit_codes as ann


def brute(rows, k):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in usable:
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def search(spark, rows, k=20, **options):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(table, F.pmod("vec_id", F.lit(20)) == 0, k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def floats(*shape, seed=0):
    return np.random.default_rng(seed).standard_normal(shape).astype(np.float32).astype(float).tolist()


def test_against_brute_force_with_odd_vectors(spark):
    rows = list(enumerate(floats(400, 24)))
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(40, rows[40][1])]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 24), (2060, [float("nan")] * 24), (2080, [None] + [1.0] * 23), (2100, [float("inf")] * 24), (None, rows[1][1])]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3002, [0.5, 0.5])]
    want, got = brute(rows, 20), search(spark, rows)
    assert got.keys() == want.keys()
    found = sum(len({j for j, _ in want[i]} & {j for j, _ in got[i]}) for i in want)
    assert found / sum(map(len, want.values())) >= 0.99
    assert got[3000] == [(3001, 4.0), (3002, 1.5)]
    assert [j for j, _ in got[1000]][:20] == [j for j, _ in want[1000]]
    for i, near in got.items():
        assert all(abs(s - dict(want[i]).get(j, s)) < 1e-9 for j, s in near)


@pytest.mark.parametrize("dim", [1, 7, 64])
def test_recall_over_blocks(spark, monkeypatch, dim):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 200)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    rows = list(enumerate(floats(700, dim, seed=dim)))
    want, got = brute(rows, 5), search(spark, rows, 5)
    found = sum(len({j for j, _ in want[i]} & {j for j, _ in got[i]}) for i in want)
    assert found / sum(map(len, want.values())) >= 0.9


def test_bounds_leave_most_vectors_out():
    data = np.array(floats(4000, 256)) + np.repeat(np.array(floats(40, 256, seed=9)) * 2, 100, axis=0)
    centre = data.mean(axis=0)
    apart = data - centre
    distance = np.linalg.norm(apart, axis=1)
    turned = apart @ ann.rotation(256) / distance[:, None]
    import pandas as pd

    codes = pd.DataFrame({"vector": list(data), "code": [b.tobytes() for b in np.packbits(turned >= 0, axis=1)], "distance": distance,
                          "along": data @ centre, "match": np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])})
    q, r, s, share = ann.search_block(codes, data[:200:20], centre, 10, ann.EPSILON, ann.SEED)
    exact = data @ data[:200:20].T
    want = np.argsort(-exact, axis=0)[:10]
    assert all(set(r[q == j]) == set(want[:, j]) for j in range(10))
    assert share < 0.1


def test_empty_and_no_queries(spark):
    assert search(spark, []) == {}
    assert search(spark, [(1, [1.0]), (2, [2.0])]) == {}
    assert search(spark, [(20, [1.0])]) == {}
