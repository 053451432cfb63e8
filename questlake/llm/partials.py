"""Two-step aggregation of mergeable sketches: one partial per task and group, then merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partials of one group are first merged in so many parts, then in one.
FAN_IN = 32

Merge = Callable[[list[dict]], dict]


def merge_step(partials: DataFrame, keys: Sequence[str], merge: Merge, schema: str, max_held: int = 64, by: Sequence[str] = ()) -> DataFrame:
    """Merge the partials of each group of ``keys`` (and ``by``, which isn't kept).

    Rows are clustered and sorted by key and merged as they stream by; a group with
    more than ``max_held`` partials is folded as it comes, so memory is bounded by
    sketches and not by their number.
    """
    group = [*keys, *by]
    names = [c.partition(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        arrow = None

        def flush():
            return pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=arrow)

        def folded(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
            now, held = None, []
            for batch in source:
                nonlocal arrow
                arrow = arrow or pa.schema([batch.schema.field(n) for n in names])
                for row in batch.to_pylist():
                    key = tuple(row[k] for k in group)
                    if held and key != now:
                        yield now, held
                        held = []
                    now = key
                    held.append(row)
                    if len(held) == max_held:
                        held = [dict(zip(group, now)) | merge(held)]
            if held:
                yield now, held

        for key, held in folded(batches):
            one = merge(held) if len(held) > 1 else held[0]
            out.append(dict(zip(group, key)) | one)
            if len(out) == 500:
                yield flush()
                out = []
        if out:
            yield flush()

    return partials.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def merge_all(partials: DataFrame, keys: Sequence[str], merge: Merge, schema: str) -> DataFrame:
    """Merge in two steps, so that a group present in every task meets no single task with all its partials.

    ``partials`` carries `_task`; it spreads the first step and is dropped.
    """
    spread = partials.withColumn("_task", F.pmod(F.col("_task"), F.lit(FAN_IN)))
    first = merge_step(spread, keys, merge, schema, by=["_task"])
    return merge_step(first, keys, merge, schema)
