"""Packing: every item once, nothing over capacity, little space left."""

import numpy as np
import pytest

from questlake.llm.packing import few_item_patterns, nnls, pack, pack_texts, plan_packing


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.normal(size=12)
        x = nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and gradient.max() < 1e-6 and np.abs(gradient[x > 1e-9]).max(initial=0) < 1e-6


def test_patterns_fill_exactly():
    got = few_item_patterns(7, np.array([0, 1, 1, 0, 1, 1, 0, 0]), 3)
    assert sorted(got) == sorted({(5, 2), (5, 1, 1), (4, 2, 1)})


@pytest.mark.parametrize("kind,fill", [("uniform", 0.98), ("short", 0.999), ("one", 0), ("none", 0), ("full", 1)])
def test_plan_gives_each_rank_one_place(kind, fill):
    rng = np.random.default_rng(1)
    sizes = {"uniform": rng.integers(1, 513, 50_000), "short": rng.geometric(0.05, 50_000).clip(1, 512), "one": np.array([3]), "none": np.array([], int), "full": np.full(9, 512)}[kind]
    histogram = np.bincount(sizes, minlength=513)
    plan = plan_packing(histogram)
    assert (plan.used[1:] == histogram[1:]).all()
    used = np.zeros(plan.containers, np.int64)
    for length, lo, hi, base, count, _ in plan.rows:
        repeats = (hi - lo) // count
        used[base : base + repeats] += length * count
    assert (used <= 512).all() and (used > 0).all()
    assert sizes.sum() >= fill * 512 * plan.containers


SIZES = "doc_id bigint, n_tokens int, piece string, container_id string"


@pytest.mark.parametrize("per_bucket", [1_000_000, 20])
def test_pack_places_items_without_overlap(spark, per_bucket):
    rng = np.random.default_rng(2)
    sizes = [*map(int, rng.integers(0, 90, 400)), None, 100, 200, 250, 1000, *([33] * 300)]
    df = spark.createDataFrame([(i, n, "x", "y") for i, n in enumerate(sizes)], SIZES)
    rows = pack(df, 100, rows_per_bucket=per_bucket).collect()
    total, places = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        if r.n_tokens:
            places.setdefault(r.container_id, []).append((r.start, r.start + r.n_tokens))
        else:
            assert r.container_id is None and r.start is None
    assert total == {i: n or 0 for i, n in enumerate(sizes)}
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 100 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    split = {r.doc_id for r in rows if r.piece > 0}
    assert split == {i for i, n in enumerate(sizes) if n and n > 100}
    assert sorted(places) == list(range(len(places)))
    assert sum(n or 0 for n in sizes) >= 0.94 * 100 * len(places)


def best_fit_decreasing(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=free.__getitem__)] -= s
        else:
            free.append(capacity - s)
    return len(free)


@pytest.mark.parametrize("low,high", [(1, 101), (30, 75), (49, 56), (1, 30)])
def test_no_more_containers_than_best_fit_decreasing(low, high):
    sizes = np.random.default_rng(low).integers(low, high, 800)
    assert plan_packing(np.bincount(sizes, minlength=101)).containers <= best_fit_decreasing(map(int, sizes), 100)


def test_texts_empty_and_very_long(spark):
    docs = spark.createDataFrame([(1, "a short text", "c"), (2, None, "c"), (3, "", "c"), (4, "word " * 50_000, "c")], "doc_id bigint, text string, container_id string")
    rows = pack_texts(docs, 512).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4}
    assert sum(r.n_tokens for r in rows if r.doc_id == 4) >= 50_000 and max(r.n_tokens for r in rows) == 512
    assert pack_texts(docs.limit(0), 512).count() == 0
