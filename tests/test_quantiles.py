"""Exact quantiles by rank selection against sorted lists."""

import math
import random

import pytest

from ethoframe.operators.quantiles import medians, quantiles

AT = (0.0, 0.1, 0.5, 0.99, 1.0)


def expected(values, q):
    x = sorted(v for v in values if v is not None and not math.isnan(v))
    if not x:
        return None
    place = q * (len(x) - 1)
    low, high = math.floor(place), math.ceil(place)
    return x[low] if low == high else (high - place) * x[low] + (place - low) * x[high]


@pytest.mark.parametrize("limit", [1_000_000, 40, 1])
def test_quantiles(spark, limit):
    rng = random.Random(9)
    kinds = {
        "flat": lambda: rng.uniform(-5, 5), "ties": lambda: float(rng.randint(0, 3)), "one": lambda: 2.5, "steep": lambda: 10.0 ** rng.uniform(-300, 300), "gaps": lambda: rng.choice([None, math.nan, rng.gauss(0, 1)]),
        "ends": lambda: rng.choice([math.inf, -math.inf, rng.random(), 0.0, -0.0]), None: lambda: rng.random(), "missing": lambda: None, "cluster": lambda: rng.choice([1e9, rng.random() * 1e-9]),
    }
    rows = [(k, f(), f()) for k, f in kinds.items() for _ in range(150)] + [("single", 7.0, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    got = {r.g: r for r in quantiles(df, ["g"], ["a", "b"], AT, limit).collect()}
    assert set(got) == {*kinds, "single"}
    for g, r in got.items():
        for c, values in (("a", [x for k, x, _ in rows if k == g]), ("b", [x for k, _, x in rows if k == g])):
            want = [expected(values, q) for q in AT]
            assert all(w is None and v is None or v == w or math.isnan(v) and math.isnan(w) for v, w in zip(r[c], want, strict=True)), (g, c)
    (whole,) = medians(df, [], ["a"], limit).collect()
    assert whole.a == expected([x for _, x, _ in rows], 0.5)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, a int")
    assert quantiles(empty, ["g"], ["a"]).count() == 0 and quantiles(empty, [], ["a"]).first().a == [None]
