import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import negatives


def brute(rows, anchor, positives=5, most=3, low=50, high=95, scale=1.0):
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            row = label, tuple(int(np.floor(x * scale)) for x in v)
            good[i] = min(good.get(i, row), row)
    out = []
    for a, (label, v) in good.items():
        if a % anchor:
            continue
        score = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, (l, w) in good.items() if i != a and len(w) == len(v))
        for p, i, _ in [s for s in score if s[2] == label][:positives]:
            band = [s for s in score if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:most]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(band)]
    return sorted(out)


def mined(spark, rows, anchor, schema="vec_id long, label int, vector array<double>", **options):
    found = negatives.mine(spark.createDataFrame(rows, schema), F.pmod("vec_id", F.lit(anchor)) == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def vectors(n, dim, spread, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dim))
    return [[float(x) for x in centres[i % 5] + spread * r.standard_normal(dim)] for i in range(n)]


@pytest.mark.parametrize("spread", [0.2, 2.0])
def test_against_brute_force_over_many_blocks(spark, monkeypatch, spread):
    for name, value in (("BLOCK", 60), ("PER_CENTRE", 50), ("GROUP", 7), ("STEP", 16), ("FIRST", 1)):
        monkeypatch.setattr(negatives, name, value)
    rows = [(i, i * 7 % 4, v) for i, v in enumerate(vectors(400, 6, spread, 1))]
    rows += [(1000 + i, 1, rows[10][2]) for i in range(40)] + [(2000 + i, 2, rows[10][2]) for i in range(40)]  # copies under two labels
    rows += [(10, 3, rows[11][2]), rows[20], rows[20]]  # an id of two rows, a repeated row
    rows += [(3000, None, [1.0] * 6), (3010, 1, None), (3020, 1, []), (3030, 1, [None] + [1.0] * 5), (3040, 1, [float("nan")] * 6),
             (3050, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (3060, 1, [0.0] * 6), (3070, 1, [9.0, 9.0]), (3071, 1, [8.0, 9.0]), (3072, 2, [7.0, 6.0])]
    want = brute(rows, 10, scale=16.0)
    assert len(want) > 300 and any(r[0] == 3070 for r in want)
    assert mined(spark, rows, 10, scale=16.0) == want


def test_few_rows_ties_and_extra_columns(spark):
    rows = [(0, 1, [2.0, 0.0]), (1, 1, [3.0, 0.0]), (2, 2, [2.0, 5.0]), (3, 2, [2.0, 1.0]), (4, 3, [2.0, 7.0]), (5, 3, [2.0, -1.0])]
    got = mined(spark, [(*r, "x", 7) for r in rows], 50, "vec_id long, label int, vector array<double>, first string, centre int")
    assert got == brute(rows, 50) == [(0, 1, 1, 2, 6, 4), (0, 1, 2, 3, 6, 4), (0, 1, 3, 4, 6, 4)]
    assert mined(spark, rows[:1], 50) == [] and mined(spark, [], 50) == [] and mined(spark, rows[1:], 50) == []


def test_negative_and_zero_positive_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-3.0, 0.0]), (2, 2, [-2.0, 0.0]), (3, 1, [0.0, 1.0]), (4, 2, [0.0, 5.0])]
    assert mined(spark, rows, 50) == brute(rows, 50) == [(0, 3, 1, 4, 0, 0)]


def test_walks_stop_early():
    r = np.random.default_rng(3)
    points = np.vstack([r.normal(c, 3, (1000, 2)) for c in ((300, 0), (0, 300), (-300, 0))]).round().astype(np.int64)
    members = points[:20]
    centre = members.mean(axis=0) / np.linalg.norm(members.mean(axis=0))
    length = np.linalg.norm(points, axis=1)
    angle = np.arccos(np.clip(points @ centre / length, -1, 1))
    radius = angle[:20].max()
    bound = length * np.cos(np.maximum(angle - radius, 0))
    order = np.lexsort((np.arange(3000), -bound))
    low, high = np.full((20, 1), -(1 << 62)), np.full((20, 1), 1 << 61)
    m, q, c, s, met = negatives.walk(bound[order], points[order], np.zeros(3000, int), order, members, np.zeros(20, int), low, high, True, 4, 100)
    exact = members @ points.T
    for i in range(20):
        best = np.lexsort((np.arange(3000), -exact[i]))[:4]
        assert list(order[c[m == i]]) == list(best) and list(s[m == i]) == list(exact[i][best])
    assert met.max() <= 1200


def test_scores_stay_exact_or_fail():
    big = np.array([[(1 << 30) + 1, 3]])
    assert negatives.products(big, big)[0, 0] == ((1 << 30) + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        negatives.products(big << 10, big)
