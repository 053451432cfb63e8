"""First-wins events kept by day, corrected by every batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlake.functions.scalars import micros
from questlake.operators.id_runs import RunSet, text_id
from questlake.operators.keyed_table import KeyedTable
from questlake.operators.layers import first_wins
from questlake.workspace import Folder, materialise


@dataclass
class Change:
    """What a batch changes: rows that enter, rows that they replace, and the (day, server) pairs of both."""

    batch_id: int
    entering: DataFrame
    leaving: DataFrame
    touched: DataFrame
    index: RunSet


class EventStore:
    """One row per event_id, the earliest by event time, in files by day; an index leads from an identifier to its day.

    A batch looks its identifiers up in the index (see ``RunSet``), reads only the days
    on which some of them stand, and rewrites only the days that change. Nothing is in
    force until ``commit``, whose one manifest names both the files and the index's
    runs: a caller that publishes results first finds the same change again on replay.

    Rows need event_id and event_time; ties go to the columns in the order of
    ``layers.TIE_BREAK``. An empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.events = KeyedTable(spark, f"{self.folder}/events", f"{columns}, dt date", ["event_id"])
        self.names = [n for n in self.events.schema.names if n != "dt"]

    def _day(self) -> F.Column:
        return F.to_date("event_time").alias("dt")

    def settle(self, batch: DataFrame, batch_id: int) -> Change:
        """The change that a batch makes to what is in force."""
        state = self.events.manifest.load()[1]
        index = RunSet(self.spark, self.folder, state.get("ids"))
        work = f"{self.folder}/work/batch={batch_id}"
        new = first_wins(batch.select(*self.names)).withColumn("_id", text_id(F.col("event_id")))
        looked = materialise(index.look_up(new, value="_old"), f"{work}/new")
        stands = F.to_date(F.timestamp_micros("_old"))
        days = [r[0] for r in looked.where("_known").select(stands).distinct().collect()]  # calendar days
        known = looked.where("_known").select("event_id")
        old = self.events.read(days).select(*self.names).join(known, "event_id", "left_semi")
        both = looked.select(*self.names, F.lit(1).alias("_new")).unionByName(old.withColumn("_new", F.lit(0)))
        # the row in force wins against an equal one
        best = first_wins(both, ties=(*(c for c in self.names if c not in ("event_id", "event_time")), "_new"))
        entering = materialise(best.where("_new = 1").select(*self.names, self._day()), f"{work}/entering")
        leaving = materialise(old.join(entering.select("event_id"), "event_id", "left_semi").select(*self.names, self._day()), f"{work}/leaving")
        touched = materialise(entering.unionByName(leaving).select("dt", "server_id").distinct(), f"{work}/touched")
        return Change(batch_id, entering, leaving, touched, index)

    def after(self, change: Change) -> DataFrame:
        """All events of the touched (day, server) pairs as they will stand."""
        days = [r[0] for r in change.touched.select("dt").distinct().collect()]  # calendar days
        staying = self.events.read(days).join(change.entering.select("event_id"), "event_id", "left_anti")
        same = F.col("dt").eqNullSafe(F.col("_dt")) & F.col("server_id").eqNullSafe(F.col("_server"))
        pairs = change.touched.select(F.col("dt").alias("_dt"), F.col("server_id").alias("_server"))
        return staying.unionByName(change.entering).join(pairs, same, "left_semi")

    def commit(self, change: Change) -> None:
        """Put the change in force."""
        index, batch = change.index, change.batch_id
        if self.events.seen(batch):
            return
        index.retired, gone = [], index.retired
        index.add_ids(change.entering, f"ids/batch={batch}", change.entering.count(), identifier=text_id(F.col("event_id")), t=micros(F.col("event_time")))
        moved = change.entering.withColumn("op", F.lit("upsert")).unionByName(change.leaving.withColumn("op", F.lit("delete")))
        self.events.merge(moved, batch, extra={"ids": index.state})
        files = Folder(self.spark, self.folder)
        for path in [*gone, f"work/batch={batch}"]:
            files.delete(path)
