"""Per-period figures by event time, corrected as late records arrive until a cut-off."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from questlake.operators.id_runs import RunSet, text_id
from questlake.workspace import Folder, Manifest, new_folder

KEYS = ("event_id", "event_time", "player_id", "produce_ts", "sink_ts")
RAW = "server_id int, window_start timestamp_ntz, player_id bigint, sink_ts timestamp_ntz, part string"
FIGURES = (
    "server_id int, window_start timestamp_ntz, event_cnt bigint, player_cnt bigint, on_time_event_cnt bigint, "
    "late_event_cnt bigint, last_sink_ts timestamp_ntz, part string"
)
#: Lengths of parts by their name's pattern; parts of other patterns are kept for good.
PART_LENGTHS = {"yyyy-MM-dd": ("%Y-%m-%d", 86_400), "yyyy-MM-dd-HH": ("%Y-%m-%d-%H", 3_600)}
#: Figures of so many closed parts are put together into one folder.
CLOSED = 64


class LateCorrector:
    """Event and player counts per server and period, kept right batch by batch.

    Tables in the folder: retained raw events (partitioned by a coarse part of event
    time), an index of every identifier seen (see ``RunSet``) and the figures by part.
    A small manifest names the files in force. A batch

    1. keeps of each identifier the first delivery, in the batch and against the index;
    2. retains what isn't past the cut-off of its period;
    3. finds the parts that it touched, recomputes them entirely from the retained raw
       events, writes them as new files and
    4. publishes the next manifest: one rename, so readers see the old or the new
       figures, never a mixture, and a batch that died leaves the old ones.

    A batch number that was published is skipped, so replays are harmless. Batches must
    come in the order of delivery (`sink_ts`), as a log gives them: once a part's last
    period is past its cut-off by one period, no record can touch it again, so its raw
    events are deleted, and the figures of ``CLOSED`` such parts are put together. The
    index keeps identifiers for good, since a late copy may bear another time.

    Records with a null in any of the key and time columns don't count. Ties on
    sink_ts go to the earlier event_time, then produce_ts, server_id, player_id. A null
    server_id is a group of its own. An empty batch publishes nothing new.
    """

    def __init__(self, spark: SparkSession, folder: str, period_seconds: int = 60, grace_seconds: int = 5, cutoff_seconds: int = 1800, part: str = "yyyy-MM-dd-HH"):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.period, self.grace, self.cutoff, self.part = period_seconds, grace_seconds, cutoff_seconds, part
        self.files = Folder(spark, folder)
        self.manifest = Manifest(self.files)

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(*(f"{self.folder}/{p}" for p in paths))

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def _parts(self, name: str) -> list[str]:
        return [p.partition("=")[2] for p in self.files.listdir(name) if p.startswith("part=")]

    def apply(self, batch: DataFrame, batch_id: int) -> int:
        """Take one batch; returns the number of parts that were recomputed."""
        number, state = self.manifest.load()
        if state and batch_id <= state["batch"]:
            return 0
        state = {"raw": {}, "figures": {}, "closed": [], "gone": [], "last": ""} | state
        ids = RunSet(self.spark, self.folder, state.get("ids"))
        order = [F.col(c).asc_nulls_last() for c in ("sink_ts", "event_time", "produce_ts", "server_id", "player_id")]
        counting = batch.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS)).select(*KEYS, "server_id")
        first = counting.withColumn("_rn", F.row_number().over(W.partitionBy("event_id").orderBy(*order))).where("_rn = 1")
        start = F.window("event_time", f"{self.period} seconds").getField("start")
        placed = first.withColumn("window_start", start).select(text_id(F.col("event_id")).alias("_id"), "server_id", "window_start", "player_id", "sink_ts")
        in_time = F.col("sink_ts") <= F.col("window_start") + F.expr(f"INTERVAL {self.period + self.cutoff} SECONDS")
        novel = ids.look_up(placed).where("NOT _known").drop("_known").withColumn("kept", in_time).withColumn("part", F.date_format("window_start", self.part))
        at = f"novel/batch={batch_id}"
        self._write(novel, at, "kept", "part")
        written = self.spark.read.schema("_id binary, sink_ts timestamp_ntz, kept boolean, part string").parquet(f"{self.folder}/{at}")
        count, last = written.agg(F.count("*"), F.max("sink_ts").cast("string")).first()
        ids.retired, gone = [], [*ids.retired, *state["gone"]]
        ids.add_ids(written, f"ids/batch={batch_id}", count)
        touched = self._parts(f"{at}/kept=true")
        for p in touched:
            state["raw"].setdefault(p, []).append(f"{at}/kept=true/part={p}")
        if touched:
            whole = self._read(RAW, [f for p in touched for f in state["raw"][p]])
            self._write(self._figures(whole), f"figures/batch={batch_id}", "part")
            state["figures"] |= {p: f"figures/batch={batch_id}/part={p}" for p in touched}
        state["last"] = max(state["last"], last or "")
        state["gone"] = self._close(state, batch_id)
        self.manifest.publish(number + 1, state | {"ids": ids.state, "batch": batch_id})
        for path in gone:  # what the state before this one still named
            self.files.delete(path)
        return len(touched)

    def _close(self, state: dict, batch_id: int) -> list[str]:
        """Let go of what no later record can touch; the paths that the next state doesn't need."""
        if self.part not in PART_LENGTHS or not state["last"]:
            return []
        pattern, seconds = PART_LENGTHS[self.part]
        delivered = dt.datetime.fromisoformat(state["last"])
        over = lambda p: dt.datetime.strptime(p, pattern) + dt.timedelta(seconds=seconds + self.period + self.cutoff) < delivered
        gone = [path for p in state["raw"] if over(p) for path in state["raw"][p]]
        state["raw"] = {p: paths for p, paths in state["raw"].items() if not over(p)}
        closed = sorted(p for p in state["figures"] if p not in state["raw"])
        if len(closed) >= CLOSED:
            paths = [state["figures"].pop(p) for p in closed]
            self._read(FIGURES, paths).drop("part").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/closed/batch={batch_id}")
            state["closed"].append(f"closed/batch={batch_id}")
            gone += paths
        return gone

    def _figures(self, raw: DataFrame) -> DataFrame:
        late = F.col("sink_ts") > F.col("window_start") + F.expr(f"INTERVAL {self.period + self.grace} SECONDS")
        return raw.groupBy("part", "server_id", "window_start").agg(
            F.count("*").alias("event_cnt"),
            F.countDistinct("player_id").alias("player_cnt"),
            F.count_if(~late).alias("on_time_event_cnt"),
            F.count_if(late).alias("late_event_cnt"),
            F.max("sink_ts").alias("last_sink_ts"),
        )

    def figures(self) -> DataFrame:
        """The figures now in force. late_event_cnt > 0 means that the period had to be corrected."""
        _, state = self.manifest.load()
        closed = [f"{self.folder}/{p}" for p in state.get("closed", [])]
        out = self._read(FIGURES, sorted(state.get("figures", {}).values())).drop("part")
        return out.unionByName(self.spark.read.schema(out.schema).parquet(*closed)) if closed else out


def by_delivery(rows: DataFrame, batches: int) -> Iterator[DataFrame]:
    """Equal spans of delivery time that together hold every delivered row, in order."""
    lo, hi = rows.agg(F.min("sink_ts"), F.max("sink_ts")).first()
    if lo is None:
        return
    step = (hi - lo) / batches
    # as text: a literal made from a Python time would depend on the driver's own time zone
    cut = lambda k: F.lit((lo + k * step).isoformat(sep=" ")).cast("timestamp_ntz")
    for k in range(batches):
        mine = F.col("sink_ts") >= cut(k) if k else F.col("sink_ts").isNotNull()
        yield rows.where(mine & (F.col("sink_ts") < cut(k + 1)) if k < batches - 1 else mine)


def corrected_figures(rows: DataFrame, batches: int = 4, folder: str | None = None, **options) -> DataFrame:
    """Run a table of deliveries through the corrector in ``batches`` steps; the figures at the end.

    The result doesn't depend on where the batches are cut. Rows never delivered (null
    sink_ts) don't count.
    """
    spark = rows.sparkSession
    corrector = LateCorrector(spark, folder or new_folder(spark, "late"), **options)
    for k, batch in enumerate(by_delivery(rows, batches)):
        corrector.apply(batch, k)
    return corrector.figures()
