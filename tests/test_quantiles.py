"""Exact percentiles by the built-in aggregate and by ranges."""

import numpy as np

from merrow.operators.quantiles import percentiles


def test_both_ways_are_exact(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(x)) for g in ("a", None, "b") for x in rng.integers(0, 50, 400)] + [("c", 7.0), ("d", None)]
    df, shares = spark.createDataFrame(data, "g string, x double"), [0.0, 0.1, 0.5, 0.95, 1.0]
    want = {g: np.quantile([x for k, x in data if k == g], shares) for g in ("a", None, "b", "c")}
    for held in (10**6, 10):
        got = {r.g: r.p for r in percentiles(df, "x", shares, ["g"], held).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[g], want[g]) for g in want)
        whole = percentiles(df, "x", shares, (), held).first().p
        assert np.allclose(whole, np.quantile([x for _, x in data if x is not None], shares))
