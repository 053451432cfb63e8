"""Distinct counts over huge identifier sets by the k smallest hash values."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questlake.llm.partials import merge_all, merge_step

SKETCH = "theta double, hashes binary"
ARROW = [("theta", pa.float64()), ("hashes", pa.binary())]
SPAN = 2.0**64
#: A task hands out its partial sketches beyond so many held hashes.
HELD_HASHES = 8_000_000
BUFFER = 400_000


class KMinSketch:
    """The k smallest different hashes of a set, and the threshold theta below which they are complete.

    Up to k identifiers the set is held whole (theta 1) and all counts are exact.
    Beyond, a count is the number of hashes below theta, divided by theta: its relative
    standard error is about 1/√k. Unions keep the smallest; intersections and
    differences count the hashes below the common theta that are in both, or in one.
    """

    def __init__(self, k: int, hashes: np.ndarray | None = None, theta: float = 1.0):
        self.k, self.theta = k, theta
        self.hashes = np.empty(0, np.uint64) if hashes is None else hashes
        self._trim()

    def _trim(self) -> None:
        if len(self.hashes) > self.k:
            # complete below the (k+1)-th smallest, which itself is left out
            self.theta = min(self.theta, float(self.hashes[self.k]) / SPAN)
            self.hashes = self.hashes[: self.k]

    def update(self, sorted_unique: np.ndarray) -> None:
        if self.theta < 1:
            sorted_unique = sorted_unique[: np.searchsorted(sorted_unique, np.uint64(min(self.theta * SPAN, SPAN - 2048)))]
        self.hashes = np.union1d(self.hashes, sorted_unique)
        self._trim()

    def below(self, theta: float) -> np.ndarray:
        return self.hashes if theta >= 1 else self.hashes[self.hashes.astype(np.float64) / SPAN < theta]

    def union(self, other: KMinSketch) -> KMinSketch:
        theta = min(self.theta, other.theta)
        return KMinSketch(self.k, np.union1d(self.below(theta), other.below(theta)), theta)

    def intersection(self, other: KMinSketch) -> tuple[int, float]:
        theta = min(self.theta, other.theta)
        return len(np.intersect1d(self.below(theta), other.below(theta), assume_unique=True)), theta

    def difference(self, other: KMinSketch) -> tuple[int, float]:
        theta = min(self.theta, other.theta)
        return len(np.setdiff1d(self.below(theta), other.below(theta), assume_unique=True)), theta

    def row(self) -> dict:
        return {"theta": self.theta, "hashes": self.hashes.tobytes()}

    @classmethod
    def of(cls, row: dict, k: int) -> KMinSketch:
        return cls(k, np.frombuffer(row["hashes"], np.uint64), row["theta"])


def estimate(count: int, theta: float, deviations: float = 2.0) -> tuple[float, float, float]:
    """Estimate and bounds from the number of hashes below theta.

    The number is binomial with rate theta, so the bounds are those of Wilson's
    interval; with theta 1 all three are the exact count.
    """
    if theta >= 1:
        return float(count), float(count), float(count)
    z2 = deviations**2 * (1 - theta)
    middle, spread = count + z2 / 2, math.sqrt(z2 * (count + z2 / 4))
    return count / theta, max(float(count), (middle - spread) / theta), (middle + spread) / theta


def _merge(k: int):
    def merge(rows: list[dict]) -> dict:
        total = KMinSketch.of(rows[0], k)
        for row in rows[1:]:
            total = total.union(KMinSketch.of(row, k))
        return total.row()

    return merge


def _build(keys: Sequence[str], k: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        sketches: dict[tuple, KMinSketch] = {}
        kinds: dict[str, pa.DataType] = {}

        def absorb(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            codes, columns = np.zeros(table.num_rows, np.int64), []
            for key in keys:
                d = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
                names, index = d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)
                codes = np.unique(codes * len(names) + index, return_inverse=True)[1]
                columns.append((names, index))
            hashes = table.column("_h").to_numpy().view(np.uint64)
            order = np.lexsort((hashes, codes))
            by, hashes = codes[order], hashes[order]
            new = np.r_[True, (by[1:] != by[:-1]) | (hashes[1:] != hashes[:-1])]
            order, by, hashes = order[new], by[new], hashes[new]
            starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(by)]):
                key = tuple(names[index[order[a]]] for names, index in columns)
                sketches.setdefault(key, KMinSketch(k)).update(hashes[a:b])

        def hand_out() -> Iterator[pa.RecordBatch]:
            fields = pa.schema([*((key, kinds[key]) for key in keys), ("_task", pa.int32()), *ARROW])
            rows = [dict(zip(keys, key)) | {"_task": task} | s.row() for key, s in sketches.items()]
            for at in range(0, len(rows), 200):
                yield pa.RecordBatch.from_pylist(rows[at : at + 200], schema=fields)
            sketches.clear()

        held, count = [], 0
        for batch in batches:
            kinds = kinds or {key: batch.schema.field(key).type for key in keys}
            held.append(batch)
            count += batch.num_rows
            if count >= BUFFER:
                absorb(held)
                held, count = [], 0
                if sum(len(s.hashes) for s in sketches.values()) > HELD_HASHES:
                    yield from hand_out()
        if count:
            absorb(held)
        if sketches:
            yield from hand_out()

    return build


def sketch_groups(rows: DataFrame, keys: Sequence[str], identifier: str, k: int = 4096) -> DataFrame:
    """One sketch per group of ``keys``: the keys, theta and the hashes.

    Only sketches are shuffled, at most k hashes a task and group. Null identifiers
    don't count; a null key is a group of its own; an empty table gives no sketch.
    Hashes are 64 bits wide: two identifiers of n share one with odds of about n²/2^65.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{key} {kinds[key]}" for key in keys)
    hashed = rows.where(F.col(identifier).isNotNull()).select(*keys, F.xxhash64(identifier).alias("_h"))
    partials = hashed.mapInArrow(_build(keys, k), f"{schema}, _task int, {SKETCH}")
    return merge_all(partials, keys, _merge(k), f"{schema}, {SKETCH}")


def merge_groups(sketches: DataFrame, keys: Sequence[str], k: int = 4096) -> DataFrame:
    """Union of the sketches down to the given keys (days, files, combinations)."""
    kinds = dict(sketches.dtypes)
    return merge_step(sketches, keys, _merge(k), ", ".join(f"{key} {kinds[key]}" for key in keys) + f", {SKETCH}")


RESULT = "kind string, estimate double, lower double, upper double"


def counts(sketches: DataFrame, keys: Sequence[str], kind: str, k: int = 4096, deviations: float = 2.0) -> DataFrame:
    """Keys, kind, estimate, lower, upper (bounds at so many standard deviations)."""
    kinds = dict(sketches.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = pa.schema([*(batch.schema.field(key) for key in keys), ("kind", pa.string()), *((c, pa.float64()) for c in ("estimate", "lower", "upper"))])
            out = []
            for row in batch.to_pylist():
                e, lo, hi = estimate(len(row["hashes"]) // 8, row["theta"], deviations)
                out.append({key: row[key] for key in keys} | {"kind": kind, "estimate": e, "lower": lo, "upper": hi})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return sketches.mapInArrow(read, ", ".join(f"{key} {kinds[key]}" for key in keys) + ", " + RESULT)


def set_counts(pairs: DataFrame, keys: Sequence[str], k: int = 4096, deviations: float = 2.0) -> DataFrame:
    """For rows with two sketches (theta, hashes and theta2, hashes2): how many in both, in either, only in the first, only in the second."""
    kinds = dict(pairs.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = pa.schema([*(batch.schema.field(key) for key in keys), ("kind", pa.string()), *((c, pa.float64()) for c in ("estimate", "lower", "upper"))])
            out = []
            for row in batch.to_pylist():
                a, b = KMinSketch.of(row, k), KMinSketch.of({"theta": row["theta2"], "hashes": row["hashes2"]}, k)
                either = a.union(b)
                for kind, (count, theta) in {"both": a.intersection(b), "either": (len(either.hashes), either.theta), "only_first": a.difference(b), "only_second": b.difference(a)}.items():
                    e, lo, hi = estimate(count, theta, deviations)
                    out.append({key: row[key] for key in keys} | {"kind": kind, "estimate": e, "lower": lo, "upper": hi})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return pairs.mapInArrow(read, ", ".join(f"{key} {kinds[key]}" for key in keys) + ", " + RESULT)
