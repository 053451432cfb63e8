"""Percentiles of very large columns by relative-error quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questlake.llm.partials import merge_all, merge_step

SKETCH = "n bigint, lo bigint, hi bigint, sizes array<int>, states array<bigint>, items binary"
#: A task holds at most so many values before it hands out partial sketches and starts afresh.
HELD_VALUES = 4_000_000
#: The buffer of a task before it sorts it into its sketches.
BUFFER = 400_000


class RelativeSketch:
    """Compactors that protect the upper tail, with rank error proportional to the distance from it.

    Level h holds items of weight 2^h, sorted. A full level compacts a lower section,
    chosen by the binary count of its compactions, and passes every second item of it
    on; its upper half is never touched. So the rank of a value above which a share t
    of all values lies is off by a multiple of t: about 1/(4k)·t at one standard
    deviation, and exact in the extreme tail. Up to ``2·3·k`` values are held as they
    are and give exact ranks. Merging concatenates levels and compacts: the bound holds
    for any tree of merges.
    """

    SECTIONS = 3

    def __init__(self, k: int = 64):
        self.k = k
        self.n, self.lo, self.hi = 0, 0, 0
        self.levels: list[np.ndarray] = [np.empty(0, np.int64)]
        self.states: list[int] = [0]

    def _shape(self, level: int) -> tuple[int, int]:
        """Section length and number of sections of a level after its compactions: sections double as they shrink by √2."""
        sections, length, state = self.SECTIONS, float(self.k), self.states[level]
        while state >= 1 << (sections - 1) and length > 8:
            sections, length = sections * 2, length / np.sqrt(2)
        return max(4, 2 * int(length / 2)), sections

    def _capacity(self, level: int) -> int:
        length, sections = self._shape(level)
        return 2 * length * sections

    def _compress(self) -> None:
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) >= self._capacity(level):
                length, sections = self._shape(level)
                items = self.levels[level]
                ones = (~self.states[level] & (self.states[level] + 1)).bit_length()  # trailing ones + 1
                keep = len(items) // 2 + (sections - min(ones, sections)) * length
                cut = len(items) - min(keep, len(items) - 2)
                cut -= cut & 1
                coin = (self.states[level] * 0x9E3779B97F4A7C15 >> 40) & 1
                if level + 1 == len(self.levels):
                    self.levels.append(np.empty(0, np.int64))
                    self.states.append(0)
                up = items[coin:cut:2]
                self.levels[level] = items[cut:]
                self.levels[level + 1] = np.sort(np.concatenate([self.levels[level + 1], up]), kind="stable")
                self.states[level] += 1
            level += 1

    def update(self, values: np.ndarray) -> None:
        """Add values (sorted or not)."""
        if not len(values):
            return
        values = np.sort(values)
        self.lo, self.hi = (int(values[0]), int(values[-1])) if not self.n else (min(self.lo, int(values[0])), max(self.hi, int(values[-1])))
        # in pieces, so that each compaction sees what it would see from a stream
        step = max(self._capacity(0), 64)
        if len(values) > step:
            # strided pieces: each is a fair cross-section of the sorted values
            parts = -(-len(values) // step)
            pieces = [values[i::parts] for i in range(parts)]
        else:
            pieces = [values]
        for piece in pieces:
            self.n += len(piece)
            self.levels[0] = np.sort(np.concatenate([self.levels[0], piece]), kind="stable")
            self._compress()

    def merge(self, other: RelativeSketch) -> None:
        if not other.n:
            return
        self.lo, self.hi = (other.lo, other.hi) if not self.n else (min(self.lo, other.lo), max(self.hi, other.hi))
        self.n += other.n
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0, np.int64))
            self.states.append(0)
        for h, (items, state) in enumerate(zip(other.levels, other.states)):
            self.levels[h] = np.sort(np.concatenate([self.levels[h], items]), kind="stable")
            self.states[h] |= state
        self._compress()

    def quantiles(self, ps: Sequence[float]) -> list[int | None]:
        """Nearest-rank percentiles; None of an empty sketch."""
        if not self.n:
            return [None] * len(ps)
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        items, upto = items[order], np.cumsum(weights[order])
        out = []
        for p in ps:
            want = int(np.ceil(p * self.n - 1e-9))
            if want <= 1:
                out.append(self.lo)
            elif want >= self.n:
                out.append(self.hi)
            else:
                # from the upper end, where ranks are sharp: weight at or above the item
                above = upto[-1] - upto
                out.append(int(items[min(int(np.searchsorted(-above, -(self.n - want), side="left")), len(items) - 1)]))
        return out

    @property
    def exact(self) -> bool:
        return len(self.levels) == 1

    def bound(self, p: float) -> float:
        """Rank error, as a share of n, that isn't exceeded with about 99.7 % (three deviations)."""
        return 0.0 if self.exact else min(3 * 0.25 / self.k * (1 - p), 3 * 0.25 / self.k)

    def row(self) -> dict:
        return {
            "n": self.n, "lo": self.lo, "hi": self.hi, "sizes": [len(x) for x in self.levels], "states": self.states,
            "items": np.concatenate(self.levels).astype(np.int64).tobytes(),
        }

    @classmethod
    def of(cls, row: dict, k: int) -> RelativeSketch:
        s = cls(k)
        s.n, s.lo, s.hi, s.states = row["n"], row["lo"], row["hi"], list(row["states"])
        items = np.frombuffer(row["items"], np.int64)
        ends = np.cumsum(row["sizes"])
        s.levels = [items[e - z : e] for e, z in zip(ends, row["sizes"])]
        return s


ARROW = [("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("sizes", pa.list_(pa.int32())), ("states", pa.list_(pa.int64())), ("items", pa.binary())]


def _merge(k: int):
    def merge(rows: list[dict]) -> dict:
        total = RelativeSketch.of(rows[0], k)
        for row in rows[1:]:
            total.merge(RelativeSketch.of(row, k))
        return total.row()

    return merge


def _build(keys: Sequence[str], value: str, k: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        sketches: dict[tuple, RelativeSketch] = {}
        kinds: dict[str, pa.DataType] = {}

        def absorb(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            codes, columns = np.zeros(table.num_rows, np.int64), []
            for key in keys:
                d = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
                names, index = d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)
                codes = np.unique(codes * len(names) + index, return_inverse=True)[1]
                columns.append((names, index))
            values = table.column(value).to_numpy()
            order = np.lexsort((values, codes))
            sorted_codes, values = codes[order], values[order]
            starts = np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(order)]):
                key = tuple(names[index[order[a]]] for names, index in columns)
                sketches.setdefault(key, RelativeSketch(k)).update(values[a:b])

        def hand_out() -> Iterator[pa.RecordBatch]:
            fields = pa.schema([*((key, kinds[key]) for key in keys), ("_task", pa.int32()), *ARROW])
            rows = [dict(zip(keys, key)) | {"_task": task} | s.row() for key, s in sketches.items()]
            for at in range(0, len(rows), 500):
                yield pa.RecordBatch.from_pylist(rows[at : at + 500], schema=fields)
            sketches.clear()

        held, count = [], 0
        for batch in batches:
            kinds = kinds or {key: batch.schema.field(key).type for key in keys}
            held.append(batch)
            count += batch.num_rows
            if count >= BUFFER:
                absorb(held)
                held, count = [], 0
                if sum(len(x) for s in sketches.values() for x in s.levels) > HELD_VALUES:
                    yield from hand_out()
        if count:
            absorb(held)
        if sketches:
            yield from hand_out()

    return build


def sketch_groups(rows: DataFrame, keys: Sequence[str], value: str, k: int = 64) -> DataFrame:
    """One sketch per group: keys and the sketch columns.

    Each task makes sketches of what it reads, so only sketches are shuffled, however
    hot a group; they are merged in two steps. The table can be kept and merged with
    those of other days or files by ``merge_groups``. Null values don't count; a null
    key is a group of its own; an empty table gives no sketch.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{key} {kinds[key]}" for key in keys)
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("bigint").alias(value))
    partials = known.mapInArrow(_build(keys, value, k), f"{schema}, _task int, {SKETCH}")
    return merge_all(partials, keys, _merge(k), f"{schema}, {SKETCH}")


def merge_groups(sketches: DataFrame, keys: Sequence[str], k: int = 64) -> DataFrame:
    """Combine the sketches of days, files or groups down to the given keys."""
    kinds = dict(sketches.dtypes)
    return merge_step(sketches, keys, _merge(k), ", ".join(f"{key} {kinds[key]}" for key in keys) + f", {SKETCH}")


def percentiles(sketches: DataFrame, keys: Sequence[str], ps: dict[str, float], k: int = 64) -> DataFrame:
    """Values of the named percentiles, the count, and the largest rank error as a share (0: exact)."""
    kinds = dict(sketches.dtypes)
    names, shares = list(ps), list(ps.values())
    schema = ", ".join(f"{key} {kinds[key]}" for key in keys) + ", n bigint, " + ", ".join(f"{n} bigint" for n in names) + ", rank_error double"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = pa.schema([*(batch.schema.field(key) for key in keys), ("n", pa.int64()), *((n, pa.int64()) for n in names), ("rank_error", pa.float64())])
            out = []
            for row in batch.to_pylist():
                s = RelativeSketch.of(row, k)
                out.append({key: row[key] for key in keys} | {"n": s.n} | dict(zip(names, s.quantiles(shares))) | {"rank_error": max(map(s.bound, shares))})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return sketches.mapInArrow(read, schema)
