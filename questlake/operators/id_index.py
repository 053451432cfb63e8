"""Exactly one delivery per identifier, by an index of sorted identifier runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlake.functions.scalars import micros, uuid_bytes
from questlake.operators.id_runs import FAN, RUN_ARROW, RunSet, as_ids, best_first, cell_of, groups, prefix_of, run_row
from questlake.workspace import Folder, Manifest, new_folder

LAST = 2**63 - 1  # null times and batches come last
DELIVERY = "topic string, h int, id binary, t bigint, b bigint, kafka_partition int, kafka_offset bigint"
DUPLICATE = "topic string, kafka_partition int, kafka_offset bigint"
#: Rows that a local step holds at a time; beyond it, it goes on afresh and the index step settles the rest.
LOCAL_ROWS = 2_000_000


def _unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    t = table.combine_chunks()
    one = lambda name: t.column(name).chunk(0) if t.num_rows else pa.array([], t.schema.field(name).type)
    return (as_ids(one("id")), *(one(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "b", "kafka_partition", "kafka_offset")))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task: the best delivery of each identifier goes on, the others are settled."""

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        codes = table.column("topic").combine_chunks().dictionary_encode()
        ids, *keys = _unpack(table)
        topic = codes.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((*reversed(keys), ids, topic))
        same = np.zeros(len(order), bool)
        same[1:] = (ids[order][1:] == ids[order][:-1]) & (topic[order][1:] == topic[order][:-1])
        dup = np.empty(len(order), bool)
        dup[order] = same
        yield from table.append_column("dup", pa.array(dup)).to_batches(max_chunksize=100_000)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LOCAL_ROWS:
            yield from settle(held)
            held, rows = [], 0
    if rows:
        yield from settle(held)


STEP_ARROW = pa.schema([("kind", pa.string()), *RUN_ARROW, ("kafka_partition", pa.int32()), ("kafka_offset", pa.int64())])
STEP = "kind string, cell int, topic string, ids binary, h binary, t binary, b binary, p binary, o binary, kafka_partition int, kafka_offset bigint"


def _settle(reader):
    """Survivors of a batch, clustered by cell and topic, against the runs: a new run's rows, and the deliveries that lose."""

    def one(cell: int, topic: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, *new = _unpack(table)
        h = table.column("h").to_numpy()
        # copies of one identifier from several tasks: the best stays
        order, first = best_first(ids, *new)
        lost_p, lost_o = [new[2][order[~first]]], [new[3][order[~first]]]
        keep = order[first]
        ids, h, new = ids[keep], h[keep], [v[keep] for v in new]
        known, old = reader.lookup(topic, ids, h)
        better, tie = np.zeros(len(ids), bool), np.ones(len(ids), bool)
        for n, o in zip(new, old):
            better |= tie & (n < o)
            tie &= n == o
        again = known & tie  # the very delivery in force, seen once more: nothing to do
        lost_p += [new[2][known & ~better & ~again], old[2][known & better]]
        lost_o += [new[3][known & ~better & ~again], old[3][known & better]]
        enter = ~known | better
        p, o = np.concatenate(lost_p), np.concatenate(lost_o)
        if len(p):
            dups = {"kind": pa.array(["dup"] * len(p)), "cell": pa.array(np.full(len(p), -1, np.int32)), "topic": pa.array([topic] * len(p)), "kafka_partition": pa.array(p, pa.int32()), "kafka_offset": pa.array(o, pa.int64())}
            yield from pa.table({f.name: dups.get(f.name, pa.nulls(len(p), f.type)) for f in STEP_ARROW}, STEP_ARROW).to_batches()
        if enter.any():
            row = {"kind": "run", **run_row(cell, topic, ids[enter], h[enter], [v[enter] for v in new])}
            yield from pa.Table.from_pylist([row], STEP_ARROW).to_batches()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, topic), table in groups(batches, ("cell", "topic")):
            yield from one(cell, topic, table)

    return settle


class IdIndex:
    """Index of identifiers over immutable sorted runs, arrays per topic and hash prefix (see ``RunSet``).

    A batch is first deduplicated within each task, so that an identifier holding a
    third of all rows sends one row a task; the survivors are clustered by hash prefix,
    searched by bisection in the runs' cells of these prefixes, which each task opens
    itself, and enter a new run if they are novel or better than the delivery in force.
    Only the batch's survivors are shuffled, however large the index. Runs of like size
    are merged, so an identifier is rewritten a logarithmic number of times. The
    manifest names the runs in force; a published batch number is skipped, so replays
    change nothing. Batch numbers must rise.

    Preferred is the earliest event time (null last), then the lowest batch, partition
    and offset. Null and blank identifiers are none: such rows are left out, neither
    kept nor duplicates. The same delivery seen again is no duplicate of itself.
    prefix_bits is the least width of the prefix that cells are cut by (larger runs have
    more cells by themselves); merge_every is the number of like runs that are merged.
    """

    def __init__(self, spark: SparkSession, folder: str, prefix_bits: int = 0, merge_every: int = FAN, **options):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.options = {"least_bits": prefix_bits, "fan": merge_every} | options
        self.files = Folder(spark, folder)
        self.manifest = Manifest(self.files)

    @staticmethod
    def deliveries(rows: DataFrame, topic: str, event_id: str = "event_id", time: str = "event_time") -> DataFrame:
        """Identified deliveries in the index's form; rows without an identifier are not among them."""
        # any row with a visible character has an identifier; this test is cheap and runs in the scan
        return (
            rows.where(F.col(event_id).rlike(r"\S")).select(
                F.lit(topic).alias("topic"),
                uuid_bytes(F.col(event_id)).alias("id"),
                F.coalesce(micros(F.col(time)), F.lit(LAST)).alias("t"),
                F.coalesce(F.col("batch_id").cast("bigint"), F.lit(LAST)).alias("b"),
                F.col("kafka_partition").cast("int").alias("kafka_partition"),
                F.col("kafka_offset").cast("bigint").alias("kafka_offset"),
            )
        )

    def _runs(self, state: dict) -> RunSet:
        return RunSet(self.spark, self.folder, state, **self.options)

    def apply(self, batch: DataFrame, batch_no: int) -> None:
        """Take one batch of ``deliveries``."""
        number, state = self.manifest.load()
        if state and batch_no <= state["batch"]:
            return
        runs = self._runs(state)
        rows = batch.withColumn("h", prefix_of(F.col("id"))).select(*(c.partition(" ")[0] for c in DELIVERY.split(", ")))
        at = f"{self.folder}/local/batch={batch_no}"
        rows.mapInArrow(_local, DELIVERY + ", dup boolean").write.mode("overwrite").partitionBy("dup").parquet(at)
        alive = self.spark.read.schema(DELIVERY + ", dup boolean").parquet(at).where("NOT dup").drop("dup")
        bits = runs.bits_for(alive.count())  # from the files' footers
        alive = alive.withColumn("cell", cell_of(F.col("h"), bits)).repartition("cell").sortWithinPartitions("cell", "topic")
        step = f"step/batch={batch_no}"
        alive.mapInArrow(_settle(runs.reader()), STEP).write.mode("overwrite").partitionBy("kind", "cell").parquet(f"{self.folder}/{step}")
        entered = 0
        if "kind=run" in self.files.listdir(step):
            sizes = self.spark.read.parquet(f"{self.folder}/{step}/kind=run").select(F.sum(F.length("ids") / 16).cast("bigint"))
            entered = sizes.first()[0]
        runs.retired, gone = [], runs.retired
        runs.add(f"{step}/kind=run", entered, bits)
        self.manifest.publish(number + 1, runs.state | {"batch": batch_no})
        for path in gone:
            self.files.delete(path)

    def duplicates(self) -> DataFrame:
        """Every delivery that isn't the one kept: topic, kafka_partition, kafka_offset; one scan, however many batches."""
        _, state = self.manifest.load()
        out = self.spark.createDataFrame([], DUPLICATE)
        if not state:
            return out
        done = F.col("batch") <= state["batch"]  # a batch that died before its manifest doesn't count
        schema = DUPLICATE + ", batch int, "
        for folder, more, mine in (("step", "kind string, cell int", "kind = 'dup'"), ("local", "dup boolean", "dup")):
            rows = self.spark.read.schema(schema + more).parquet(f"{self.folder}/{folder}")
            out = out.union(rows.where(done & F.expr(mine)).select(*out.columns))
        return out

    def kept(self) -> DataFrame:
        """The delivery in force of each identifier."""
        entries = self._runs(self.manifest.load()[1]).entries()
        return entries.select("topic", "id", F.when(F.col("t") < LAST, F.col("t")).alias("event_us"), F.col("b").alias("batch_id"), F.col("p").alias("kafka_partition"), F.col("o").alias("kafka_offset"))


def build_index(topics: dict[str, DataFrame], batches: int = 3, folder: str | None = None, **options) -> IdIndex:
    """Feed whole tables to an index in order of batch_id, in ``batches`` spans.

    The outcome doesn't depend on where the spans are cut. Rows with a null batch_id
    come in the last span. Empty tables give an empty index.
    """
    rows = None
    for topic, df in topics.items():
        one = IdIndex.deliveries(df, topic)
        rows = one if rows is None else rows.union(one)
    spark = rows.sparkSession
    lo, hi = rows.where(F.col("b") < LAST).agg(F.min("b"), F.max("b")).first()
    index = IdIndex(spark, folder or new_folder(spark, "ids"), **options)
    if lo is None:
        lo = hi = 0
    cuts = [lo + math.ceil(k * (hi - lo + 1) / batches) for k in range(batches)]
    for k, cut in enumerate(cuts):
        mine = F.lit(True) if k == 0 else F.col("b") >= cut
        index.apply(rows.where(mine if k == batches - 1 else mine & (F.col("b") < cuts[k + 1])), k)
    return index
