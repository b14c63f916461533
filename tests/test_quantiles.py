import random

import numpy as np
import pytest

from pulsegrid.operators import quantiles

SHARES = {"p50": 0.5, "p95": 0.95, "top": 1.0}


def check(spark, rows, kind="string"):
    df = spark.createDataFrame(rows, f"g {kind}, v bigint").selectExpr("g", "v", "1 AS n", "2 AS _place")
    got = {r.g: r for r in quantiles.summary(df, "v", ["g"], SHARES).collect()}
    values = {}
    for g, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    assert set(got) == set(values)
    for g, seen in values.items():
        r = got[g]
        assert (r.n, r.lowest, r.highest) == (len(seen), min(seen), max(seen))
        assert r.mean == pytest.approx(sum(seen) / len(seen))
        assert [r.p50, r.p95, r.top] == pytest.approx([float(np.percentile(seen, 100 * s)) for s in SHARES.values()])


def test_groups_of_all_sizes(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.randint(-(10**9), 10**9)) for _ in range(20_000)]
    rows += [("two", v) for v in [5] * 3000 + [900] * 3000] + [("one", 7)] * 5000
    rows += [(None, rnd.randint(0, 50)) for _ in range(300)] + [("none", None), ("few", 3), ("few", 8)]
    rows += [("wide", v) for v in (-(2**62), 2**62, 0, 1)]
    check(spark, rows)


@pytest.mark.parametrize("wrong", [-0.3, 0.3])
def test_a_sketch_that_is_wrong_is_found_out(spark, monkeypatch, wrong):
    """Bounds on either side of the place: the counts show it, and the other side is searched."""
    rnd = random.Random(2)
    honest = quantiles.F.kll_sketch_get_quantile_bigint

    def lying(sketch, rank):
        return honest(sketch, quantiles.F.least(quantiles.F.lit(1.0), quantiles.F.greatest(quantiles.F.lit(0.0), rank + wrong)))

    monkeypatch.setattr(quantiles.F, "kll_sketch_get_quantile_bigint", lying)
    check(spark, [(f"g{i % 3}", rnd.randint(0, 10**6)) for i in range(9000)])


def test_no_values(spark):
    df = spark.createDataFrame([("a", None)], "g string, v bigint")
    assert quantiles.summary(df, "v", ["g"], SHARES).count() == 0


def test_no_window_over_values(spark):
    """What sorts per group is at most CUTS + 1 rows of a place."""
    df = spark.range(50_000).selectExpr("id % 2 AS g", "id * 7919 % 100003 AS v")
    got = quantiles.summary(df, "v", ["g"], SHARES)
    assert got.count() == 2
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
