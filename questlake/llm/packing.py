"""Filling containers of fixed capacity with items, by patterns fitted to the length histogram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from questlake.workspace import materialise, new_folder


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Non-negative least squares by the active-set method: x ≥ 0 with a·x nearest to b."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gradient = target - gram @ x
        gradient[passive] = -np.inf
        enter = int(gradient.argmax())
        if gradient[enter] <= tolerance:
            break
        passive[enter] = True
        while True:
            idx = np.flatnonzero(passive)
            s = np.linalg.lstsq(gram[np.ix_(idx, idx)], target[idx], rcond=None)[0]
            if s.min() > 0:
                break
            bad = s <= 0
            gap = x[idx[bad]] - s[bad]
            step = float(np.min(np.divide(x[idx[bad]], gap, out=np.zeros(bad.sum()), where=gap > 0)))
            x[idx] += step * (s - x[idx])
            passive[idx[x[idx] <= 1e-12]] = False
            passive[idx[bad & (x[idx] <= 1e-12)]] = False
            x[~passive] = 0
            if not passive.any():
                break
        x[:] = 0
        idx = np.flatnonzero(passive)
        if len(idx):
            x[idx] = np.maximum(0, np.linalg.lstsq(gram[np.ix_(idx, idx)], target[idx], rcond=None)[0])
    return x


def few_item_patterns(units: int, present: np.ndarray, most: int = 3) -> list[tuple[int, ...]]:
    """All non-increasing tuples of up to ``most`` classes that fill ``units`` exactly, of classes that have items."""
    has = set(np.flatnonzero(present).tolist())
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, head: tuple[int, ...]) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < most:
            for c in range(min(left, top), 0, -1):
                if c * (most - len(head)) < left:
                    break
                if c in has:
                    grow(left - c, c, (*head, c))

    grow(units, units, ())
    return out


class Plan:
    """Which ranks of each length go to which containers; its size depends on the capacity, not on the items."""

    def __init__(self, capacity: int):
        self.capacity, self.containers, self.rows, self.share = capacity, 0, [], 0.0
        self.used = np.zeros(capacity + 1, np.int64)  # ranks given out per length

    def emit(self, lengths: list[tuple[int, int]], repeats: int) -> None:
        """``repeats`` containers, each with so many items of each length."""
        at = 0
        for length, count in lengths:
            lo = int(self.used[length])
            self.rows.append((length, lo, lo + count * repeats, self.containers, count, at))
            self.used[length] += count * repeats
            at += length * count
        assert at <= self.capacity
        self.containers += repeats

    def table(self) -> tuple[np.ndarray, ...]:
        rows = sorted(self.rows)
        return tuple(np.array([r[c] for r in rows], np.int64) for c in range(6))


def plan_packing(histogram: np.ndarray, units: int = 128, most: int = 3, shares: tuple[float, ...] = (1.0, 0.8, 0.5)) -> Plan:
    """Plan for ``histogram[length]`` items of each length up to the capacity (its last index).

    1. Lengths are put into ``units`` equal classes, and all patterns of up to ``most``
       classes that fill a container are enumerated. Non-negative least squares fits
       their repeat counts to the class histogram; long classes weigh more, since short
       items find a place in any gap.
    2. The counts are rounded and run, most frequent first. A pattern takes the long
       end of one class and the short end of the next, and the gap that is left is
       filled with the longest items that fit.
    3. The residual is packed longest first, a pattern of lengths at a time, repeated
       until one of them runs out.

    Where the residual of a full fit packs badly (few short items), running a share of
    the fitted counts does better; the share with the fewest containers is taken and
    told as the plan's ``share`` (0 only where no pattern fits a container, as of a
    single short item: then there is nothing to fit).

    All steps work on counts per length, so the plan takes the same time for a thousand
    items or a trillion.
    """
    capacity = len(histogram) - 1
    width = -(-capacity // units)
    units = capacity // width
    # a class holds the lengths up to class * width; those beyond the last class go to the residual
    classes = np.minimum(-(-np.arange(capacity + 1) // width), units + 1)
    counts = np.bincount(classes, histogram, minlength=units + 2)[: units + 1].astype(np.float64)
    counts[0] = 0
    patterns = few_item_patterns(units, counts > 0, most)
    fitted = np.zeros(0)
    if patterns:
        a = np.zeros((units + 1, len(patterns)))
        for j, p in enumerate(patterns):
            np.add.at(a[:, j], list(p), 1)
        weight = np.arange(units + 1) / units / np.sqrt(np.maximum(counts, 1))
        fitted = nnls(a * weight[:, None], counts * weight)
    best = None
    for share in shares if fitted.any() else (0.0,):
        plan = _run(histogram, classes, patterns, np.floor(fitted * share + (0.5 if share == 1 else 0)).astype(np.int64))
        plan.share = share
        if best is None or plan.containers < best.containers:
            best = plan
    return best


def _run(histogram: np.ndarray, classes: np.ndarray, patterns: list[tuple[int, ...]], repeats: np.ndarray) -> Plan:
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan, fit = Plan(capacity), _Fitter(left)
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j]:
            _run_pattern(plan, fit, left, classes, patterns[j], int(repeats[j]))
    while True:
        top = fit.longest(capacity)
        if not top:
            return plan
        count = min(capacity // top, int(left[top]))
        times = int(left[top]) // count
        left[top] -= count * times
        _fill(plan, fit, left, [(top, count)], times, capacity - top * count)


class _Fitter:
    """The longest length that is left and fits."""

    def __init__(self, left: np.ndarray):
        self.left = left

    def longest(self, free: int) -> int:
        have = np.flatnonzero(self.left[1 : free + 1])
        return int(have[-1]) + 1 if len(have) else 0


def _run_pattern(plan: Plan, fit: _Fitter, left: np.ndarray, classes: np.ndarray, pattern: tuple[int, ...], repeats: int) -> None:
    kinds, wanted = np.unique(pattern, return_counts=True)
    while repeats > 0:
        take: list[tuple[int, int]] = []
        fits = repeats
        for place, (kind, count) in enumerate(zip(kinds, wanted)):
            inside = np.flatnonzero((classes == kind) & (left > 0))
            inside = inside[::-1] if place % 2 == 0 else inside
            need = int(count)
            for length in inside:
                # as many of this length as a container takes; the rest from the next
                n = min(need, int(left[length]))
                take.append((int(length), n))
                need -= n
                if not need:
                    break
            if need:
                return
        for length, n in take:
            fits = min(fits, int(left[length]) // n)
        for length, n in take:
            left[length] -= n * fits
        repeats -= fits
        _fill(plan, fit, left, take, fits, plan.capacity - sum(length * n for length, n in take))


def _fill(plan: Plan, fit: _Fitter, left: np.ndarray, items: list[tuple[int, int]], repeats: int, free: int) -> None:
    """Fill the gap of ``repeats`` like containers, longest first; where a length runs out, they part."""
    open_ = [(items, repeats, free)]
    while open_:
        items, repeats, free = open_.pop()
        length = fit.longest(free) if free else 0
        if not length:
            plan.emit(_joined(items), repeats)
            continue
        have = int(left[length])
        if have >= repeats:
            count = min(free // length, have // repeats)
            left[length] -= count * repeats
            open_.append(([*items, (length, count)], repeats, free - length * count))
        else:
            left[length] = 0
            open_.append((items, repeats - have, free))
            open_.append(([*items, (length, 1)], have, free - length))


def _joined(items: list[tuple[int, int]]) -> list[tuple[int, int]]:
    total: dict[int, int] = {}
    for length, count in items:
        total[length] = total.get(length, 0) + count
    return list(total.items())


def _assign(table: tuple[np.ndarray, ...], id_name: str):
    lengths, lo, hi, base, count, at = table
    span = np.int64(1) << 40
    starts = lengths * span + lo

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.searchsorted(starts, n * span + rank, side="right") - 1
            offset = rank - lo[row]
            assert len(row) == 0 or ((lengths[row] == n) & (rank < hi[row])).all(), "rank outside the plan"
            container = base[row] + offset // count[row]
            place = at[row] + (offset % count[row]) * n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container), pa.array(place.astype(np.int32))], names=[id_name, "piece", "n_tokens", "container_id", "start"])

    return assign


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size: str = "n_tokens", units: int = 128, most: int = 3, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Containers for items of given sizes: id, piece, n_tokens, container_id, start (place in the container), fit_share (of the fitted counts that was run, the same for all).

    An item longer than the capacity is cut into full containers and a remainder, which
    is packed like any item; no other item is split. Items of size 0 or null take no
    place: container_id and start are null. Equal items are interchangeable; ties are
    ordered by id, and each repeated id by its own row (which of them comes first is
    left open). An empty table gives no rows.

    Only the histogram (capacity + 1 numbers) comes to the driver and only the plan,
    whose size depends on the capacity alone, goes out. An item finds its place from
    its length and its rank among the items of that length. Ranks are counted in hash
    buckets and shifted by the buckets before, so a length shared by a third of all
    items is spread over many tasks.
    """
    spark = sizes.sparkSession
    n = F.col(size)
    base = sizes.select(F.col(id_col), F.coalesce(n.cast("int"), F.lit(0)).alias("_n"))
    full, rest = F.floor(F.col("_n") / capacity).cast("int"), F.col("_n") % capacity
    parts = F.when(F.col("_n") <= capacity, F.array(F.struct(F.lit(0).alias("piece"), F.col("_n").alias("n_tokens")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), full - F.when(rest == 0, 1).otherwise(0)),
            lambda i: F.struct(i.cast("int").alias("piece"), F.when(i < full, capacity).otherwise(rest).cast("int").alias("n_tokens")),
        )
    )
    pieces = base.select(id_col, F.inline(parts))
    counts = pieces.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()  # at most capacity + 1 rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, c in counts:
        histogram[length] = c
    plan = plan_packing(histogram, units, most)
    buckets = max(1, -(-int(histogram.sum()) // rows_per_bucket))
    placed = pieces.where("n_tokens > 0").withColumn("_b", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    by_bucket = placed.groupBy("n_tokens", "_b").agg(F.count("*").alias("_c"))
    before = by_bucket.withColumn("_before", F.sum("_c").over(W.partitionBy("n_tokens").orderBy("_b")) - F.col("_c")).drop("_c")
    ranked = placed.withColumn("_r", F.row_number().over(W.partitionBy("n_tokens", "_b").orderBy(id_col, "piece")) - 1)
    ranked = ranked.join(before, ["n_tokens", "_b"]).select(id_col, "piece", "n_tokens", (F.col("_r") + F.col("_before")).alias("_rank"))
    kind = dict(sizes.dtypes)[id_col]
    schema = f"{id_col} {kind}, piece int, n_tokens int, container_id bigint, start int"
    out = ranked.mapInArrow(_assign(plan.table(), id_col), schema) if plan.rows else spark.createDataFrame([], schema)
    empty = pieces.where("n_tokens = 0").select(id_col, "piece", "n_tokens", F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("start"))
    return out.unionByName(empty).withColumn("fit_share", F.lit(float(plan.share)))


def pack_texts(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text: str = "text", path: str | None = None, **options) -> DataFrame:
    """Token-count whole texts once (kept in the shared folder) and pack them."""
    from questlake.llm.tokens import VOCABULARY, token_counts

    sizes = materialise(token_counts(docs, id_col, text, path or VOCABULARY), new_folder(docs.sparkSession, "tokens"))
    return pack(sizes, capacity, id_col, **options)
