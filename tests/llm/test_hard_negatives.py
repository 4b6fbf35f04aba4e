"""Hard negatives against all pairs scored with Python integers."""
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, a string, score double, id string"
BIG = "vec_id bigint, embedding array<double>, label int"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def brute(rows, positives=5, negatives=3):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[(i, label, tuple(v))] = [math.floor(256 * Fraction(x)) for x in v]
    out = []
    for (i, label, _), v in good.items():
        if i % 50:
            continue
        pairs = {(j == i, m == label, j, min(max(sum(p * q for p, q in zip(v, w)), LEAST), MOST))
                 for (j, m, _), w in good.items()}
        order = sorted((-s, j, same) for me, same, j, s in pairs if not me)
        for s, j, same in [o for o in order if o[2]][:positives]:
            near = [(t, n) for t, n, same in order if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(near[:negatives])]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 50 == 0, **options).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    out = []
    for i in range(600):
        v = [c + rng.gauss(0, 0.8) for c in rng.choice(centres)] if i % 3 else centres[0]     # a third are equal
        v = [float(np.float32(x / 4)) for x in v]
        out.append((i, v, rng.choice([0, 0, 0, 1, 2])))
    out += [(700, None, 1), (750, [0.5, None], 1), (800, [float("nan")] * 12, 1), (850, [float("inf")] * 12, 1),
            (900, [], 0), (950, [0.0] * 12, 1), (1000, [0.25, 0.5], 2), (None, [0.5] * 12, 1), (1050, [0.5] * 12, None),
            (1100, [0.5] * 20, 0), (-50, [0.5] * 12, 0)]
    out += [out[50], out[50], out[7], (50, [0.5] * 12, 1), (7, [0.5] * 12, 0)]
    return out


def test_equals_brute_force_at_any_tiling_and_pilot(spark, rows):
    df = spark.createDataFrame([(i, v, x, "a", 0.5, "id") for i, v, x in rows], SCHEMA).repartition(5)
    want = brute(rows)
    assert len(want) > 100
    assert mined(df) == want
    assert mined(df, tile_bytes=20 * 8 * 90, pilot_rows=7) == want
    assert mined(df.filter("vec_id % 50 = 0 or vec_id > 300"), pilot_rows=1) == brute(
        [r for r in rows if r[0] is not None and (r[0] % 50 == 0 or r[0] > 300)])


def test_more_and_fewer_neighbours(spark, rows):
    df = spark.createDataFrame([(i, v, x, "a", 0.5, "id") for i, v, x in rows[:120]], SCHEMA)
    assert mined(df, positives=200, negatives=150) == brute(rows[:120], 200, 150)


def test_empty_and_one_label(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == []
    one = spark.createDataFrame([(i, v, 1, "a", 0.5, "id") for i, v, _ in rows[:60]], SCHEMA)
    assert mined(one) == []
    alone = spark.createDataFrame([(50, [0.5, 0.5], 1, "a", 0.5, "id")], SCHEMA)
    assert mined(alone) == []


def test_components_beyond_exact_doubles(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e6, 3e7 + 0.25, 1e9, 2.0 ** 60, 1e200, 0.1, -0.3]) * rng.random() for _ in range(3)],
             i % 2) for i in range(40)]
    assert mined(spark.createDataFrame(rows, BIG)) == brute(rows)


def test_dimensions_are_left_out_of_the_index_without_loss():
    rng = np.random.default_rng(3)
    y = np.floor(rng.standard_normal((3000, 64)) * 256 / 8 * np.linspace(0.1, 2, 64))
    label = rng.integers(0, 3, 3000)
    x, xl = y[:40], label[:40]
    s = x @ y.T
    low = np.quantile(s, 0.995, axis=1).astype(np.int64)[:, None]
    a, w, i, score = hard_negatives.search(y, np.arange(3000), label, x, np.arange(40), xl, low,
                                           np.full((40, 1), MOST), 5, False)
    for k in range(40):
        ok = [(-s[k, j], j) for j in range(3000) if label[j] != xl[k] and s[k, j] >= low[k, 0]]
        assert [(-p, q) for p, q in zip(score[a == k], i[a == k])] == sorted(ok)[:5]
