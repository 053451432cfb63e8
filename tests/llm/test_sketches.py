"""Quantile and distinct sketches against exact figures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from questlake.llm import distinct, quantiles
from questlake.llm.distinct import KMinSketch, estimate
from questlake.llm.quantiles import RelativeSketch

PS = [0.01, 0.1, 0.5, 0.9, 0.99, 0.999, 0.9999]


def rank_errors(values, sketch):
    """Error of each percentile's rank as a share of what lies above it."""
    x, n, out = np.sort(values), len(values), []
    for p, v in zip(PS, sketch.quantiles(PS)):
        lo, hi, want = np.searchsorted(x, v, "left") + 1, np.searchsorted(x, v, "right"), int(np.ceil(p * n))
        out.append(max(0, lo - want, want - hi) / n / (1 - p))
    return out


@pytest.mark.parametrize("kind", ["random", "sorted", "reversed", "ties", "heavy"])
@pytest.mark.parametrize("parts", [1, 40])
def test_rank_error_is_within_the_bound(kind, parts):
    rng = np.random.default_rng(3)
    x = {"random": rng.integers(0, 10**9, 150_000), "sorted": np.arange(150_000), "reversed": np.arange(150_000)[::-1], "ties": rng.integers(0, 20, 150_000), "heavy": (rng.pareto(1, 150_000) * 1000).astype(np.int64)}[kind]
    whole = RelativeSketch(64)
    for part in np.array_split(x, parts):
        one = RelativeSketch(64)
        for piece in np.array_split(part, 7):
            one.update(piece)
        whole.merge(one)
    assert whole.n == len(x) and sum(len(v) << h for h, v in enumerate(whole.levels)) == pytest.approx(whole.n, rel=0.02)
    assert max(rank_errors(x, whole)) <= whole.bound(0)
    assert sum(map(len, whole.levels)) < 8000


def test_small_sketches_are_exact():
    x = np.random.default_rng(1).integers(-50, 50, 383)
    s = RelativeSketch(64)
    s.update(x)
    assert s.exact and s.quantiles(PS) == [int(np.sort(x)[max(0, int(np.ceil(p * len(x) - 1e-9)) - 1)]) for p in PS]
    assert RelativeSketch(64).quantiles([0.5]) == [None]


def test_sketch_survives_a_round_trip():
    s = RelativeSketch(32)
    s.update(np.arange(10_000))
    again = RelativeSketch.of(s.row(), 32)
    assert again.quantiles(PS) == s.quantiles(PS) and again.n == s.n


VALUES = "server_id int, dt date, value bigint, n int, _task string"


def test_groups_of_days_merge_to_the_whole(spark):
    rng = np.random.default_rng(2)
    day = [dt.date(2024, 1, 1 + i % 3) for i in range(30_000)]
    server = [None if i % 50 == 0 else 1 if i % 3 else 2 for i in range(30_000)]
    value = [None if i % 17 == 0 else int(v) for i, v in enumerate(rng.integers(-100, 10**6, 30_000))]
    df = spark.createDataFrame([(s, d, v, 0, "x") for s, d, v in zip(server, day, value)], VALUES).repartition(7)
    days = quantiles.sketch_groups(df, ["server_id", "dt"], "value", 32)
    out = {r.server_id: r for r in quantiles.percentiles(quantiles.merge_groups(days, ["server_id"], 32), ["server_id"], {"p50": 0.5, "p99": 0.99}, 32).collect()}
    assert set(out) == {None, 1, 2}
    for s in out:
        x = np.sort([v for a, v in zip(server, value) if a == s and v is not None])
        assert out[s].n == len(x)
        for name, p in (("p50", 0.5), ("p99", 0.99)):
            got = np.searchsorted(x, out[s][name], "right") / len(x)
            assert abs(got - p) <= out[s].rank_error * (1 - p) + 1 / len(x)


def test_empty_and_all_null_groups(spark):
    df = spark.createDataFrame([(1, None, None, 0, "x")], VALUES)
    assert quantiles.sketch_groups(df, ["server_id"], "value").count() == 0
    assert quantiles.percentiles(quantiles.sketch_groups(df.limit(0), ["server_id"], "value"), ["server_id"], {"p50": 0.5}).count() == 0
    assert distinct.sketch_groups(df, ["server_id"], "value").count() == 0


def hashed(ids):
    return np.unique(np.random.default_rng(9).integers(0, 2**64 - 1, 400_000, dtype=np.uint64)[ids])


def test_distinct_estimates_and_set_operations():
    a, b = KMinSketch(2048), KMinSketch(2048)
    for at in range(0, 200_000, 20_000):
        a.update(hashed(np.arange(at, at + 20_000)))
        b.update(hashed(np.arange(at + 100_000, at + 120_000)))
    n = len(a.hashes)
    assert n == 2048 and a.theta < 1
    for (count, theta), truth in (((n, a.theta), 200_000), (a.intersection(b), 100_000), (a.difference(b), 100_000), ((len((u := a.union(b)).hashes), u.theta), 300_000)):
        e, lo, hi = estimate(count, theta, 3)
        assert lo <= truth <= hi and abs(e - truth) / truth < 0.12
    c = a.union(b)
    assert c.row() == b.union(a).row() == KMinSketch.of(c.row(), 2048).row()


def test_bounds_hold_about_as_often_as_said():
    rng, inside = np.random.default_rng(5), 0
    for _ in range(300):
        s = KMinSketch(256, np.unique(rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64)))
        _, lo, hi = estimate(len(s.hashes), s.theta, 2)
        inside += lo <= 5000 <= hi
    assert inside >= 275


def test_counts_are_exact_below_k(spark):
    rows = [(i % 3 or None, dt.date(2024, 1, 1), i % 41 if i % 7 else None, 0, "x") for i in range(500)]
    df = spark.createDataFrame(rows, VALUES).repartition(5)
    sk = distinct.sketch_groups(df, ["server_id", "dt"], "value", 64)
    got = {r.server_id: (r.estimate, r.lower, r.upper) for r in distinct.counts(sk, ["server_id"], "x", 64).collect()}
    want = {s: float(len({r[2] for r in rows if r[0] == s and r[2] is not None})) for s in (None, 1, 2)}
    assert got == {s: (n, n, n) for s, n in want.items()}
    pairs = sk.where("server_id = 1").select("dt", "theta", "hashes").join(sk.where("server_id = 2").select("dt", F.col("theta").alias("theta2"), F.col("hashes").alias("hashes2")), "dt")
    x, y = ({r[2] for r in rows if r[0] == s and r[2] is not None} for s in (1, 2))
    assert {r.kind: r.estimate for r in distinct.set_counts(pairs, ["dt"], 64).collect()} == {"both": len(x & y), "either": len(x | y), "only_first": len(x - y), "only_second": len(y - x)}
