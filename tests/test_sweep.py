"""The sweep over a product's weeks against plain loops, over batches that cut series, and at length."""

import bisect
import datetime
import random
import time

import numpy as np
import pytest

from larder.operators import history, pricecheck, sweep

DAY = datetime.date(1970, 1, 5)


def plain(series):
    """(n, prior_low, run, cheaper) of each price, by looking at all earlier ones."""
    out = []
    for i, price in enumerate(series):
        run = 0
        while run < i and series[i - 1 - run] > price + history.EPS:
            run += 1
        out.append((i + 1, min(series[:i], default=None), run, sum(x < price for x in series[:i])))
    return out


@pytest.mark.parametrize("batch", [1, 3, 7, 10_000])
def test_sweep_equals_plain_loops(spark, batch):
    r = random.Random(batch)
    prices = [0.0, 1.0, 1.0 + 1e-10, 1.0 - 1e-10, 2.5, 3.0]
    products = {f"k{k}": [r.choice(prices) if k % 2 else r.random() for _ in range(r.choice([1, 2, 5, 40]))] for k in range(30)}
    rows = [(k, DAY + datetime.timedelta(7 * i), p) for k, s in products.items() for i, p in enumerate(s)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = sweep.swept(spark.createDataFrame(rows, "key string, d date, gp double").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {}
    for x in sorted(got, key=lambda x: (x.key, x.d)):
        found.setdefault(x.key, []).append((x.n, x.prior_low, x.run, x.cheaper))
    assert found == {k: plain(s) for k, s in products.items()}


def test_a_product_of_a_hundred_thousand_weeks(spark):
    r = np.random.default_rng(3)
    prices = np.round(r.random(100_000) * 50, 2)
    rows = [("long", DAY + datetime.timedelta(int(i)), float(p)) for i, p in enumerate(prices)]
    table = spark.createDataFrame(rows, "key string, d date, gp double")
    began = time.perf_counter()
    got = sorted((x.n, x.run, x.cheaper) for x in sweep.swept(table).collect())
    took = time.perf_counter() - began
    ordered, stack, expected = [], [], []
    for i, p in enumerate(prices.tolist()):
        cheaper = bisect.bisect_left(ordered, p)
        ordered.insert(cheaper, p)
        while stack and stack[-1][0] > p + history.EPS:
            stack.pop()
        expected.append((i + 1, i - (stack[-1][1] + 1 if stack else 0), cheaper))
        stack.append((p, i))
    assert got == expected and took < 30


def test_ranks_within_series_of_any_cut():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 5, 64, 257):
        prices = r.integers(0, 9, n).astype(float)
        starts = np.unique(np.concatenate(([0], r.integers(0, n, 4)))) if n else np.zeros(0, np.int64)
        bounds = [*starts.tolist(), n]
        expected = [sum(prices[j] < prices[i] for j in range(a, i)) for a, b in zip(bounds, bounds[1:]) for i in range(a, b)]
        assert sweep.cheaper_before(prices, starts).tolist() == expected


def test_price_checks_of_nothing(spark):
    none = spark.createDataFrame([], "key string, d date, gp double")
    for f in (pricecheck.run_length, pricecheck.percentile_prior, pricecheck.percentile_full, pricecheck.evidence):
        assert f(none).count() == 0
