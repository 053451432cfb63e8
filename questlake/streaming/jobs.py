"""Streaming jobs: watermarked windows, correctable gauges, pass-through, supervision."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from questlake.operators import metrics, reports
from questlake.operators.event_store import Change, EventStore
from questlake.operators.keyed_table import KeyedTable
from questlake.operators.layers import dungeon_day, player_day, valid_events
from questlake.schema import EVENT_TYPES, ODS_COLUMNS, PROMOTED
from questlake.sources.ods import flatten

GAUGE = "dt date, server_id int, dau bigint, pay_users bigint, pay_rate double"


def clean_stream(events: DataFrame, delay: str = "5 seconds", horizon: bool = False) -> DataFrame:
    """Valid events, each id once: for the job's life, or with ``horizon`` within the watermark's reach (bounded state)."""
    kept = valid_events(events)
    return kept.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"]) if horizon else kept.dropDuplicates(["event_id"])


def minute_windows(events: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """Distinct ids and players per closed minute. Late rows for a closed minute are dropped.

    countDistinct isn't available on streams; the size of a set is exact, its state as
    large as the open windows' identifiers.
    """
    present = events.where("event_id IS NOT NULL AND player_id IS NOT NULL AND event_time IS NOT NULL")
    return (
        present.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 minute").alias("w"))
        .agg(F.size(F.collect_set("event_id")).cast("bigint").alias("event_cnt"), F.size(F.collect_set("player_id")).cast("bigint").alias("player_cnt"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_cnt", "player_cnt")
    )


def player_day_windows(dwd: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Player-day measures, given once per key when the day has closed."""
    return reports.player_day_tumble(dwd.withWatermark("event_time", delay))


def dungeon_day_windows(dwd: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Clear rate per dungeon when the day has closed; only events that name a dungeon move the watermark."""
    return reports.dungeon_day_tumble(dwd.where("dungeon_id IS NOT NULL").withWatermark("event_time", delay))


def daily_gauge(events: DataFrame) -> DataFrame:
    """DAU and pay rate per day and server, corrected with every event; days never close (update mode)."""
    typed = events.where(F.col("event_id").isNotNull() & F.col("player_id").isNotNull() & (F.col("player_id") > 0) & F.col("event_time").isNotNull() & F.col("event_type").isin(*EVENT_TYPES))
    players, payers = F.size(F.collect_set("player_id")), F.size(F.collect_set(F.when(F.col("event_type") == "recharge", F.col("player_id"))))
    base = typed.dropDuplicates(["event_id"]).groupBy(F.to_date("event_time").alias("dt"), "server_id").agg(players.cast("bigint").alias("dau"), payers.cast("bigint").alias("pay_users"))
    return base.withColumn("pay_rate", F.col("pay_users").cast("double") / F.col("dau"))


def recharge_gauge(events: DataFrame) -> DataFrame:
    """Continuous count, DECIMAL sum and players of recharges, each id once."""
    paid = events.where("event_id IS NOT NULL AND event_type = 'recharge' AND player_id IS NOT NULL AND amount IS NOT NULL")
    return paid.dropDuplicates(["event_id"]).groupBy(F.lit("recharge_total").alias("agg_key")).agg(
        F.count("*").alias("recharge_cnt"), F.sum("amount").cast("decimal(18,2)").alias("recharge_sum"), F.size(F.collect_set("player_id")).cast("bigint").alias("players")
    )


def passthrough(events: DataFrame) -> DataFrame:
    """Stateless filter (id, player and time of publishing are there) with a processing-time stamp, constant within a micro-batch."""
    return events.where("event_id IS NOT NULL AND player_id IS NOT NULL AND produce_ts IS NOT NULL").withColumn("sink_ts", F.current_timestamp())


def to_keyed(updates: DataFrame, table: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Write an update-mode stream to a keyed table."""
    sink = lambda df, batch: table.merge(df.withColumn("op", F.lit("upsert")), batch)
    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(**(trigger or {"availableNow": True})).start()


class LiveMetrics:
    """Several results of one stream: the metrics and the player-day and dungeon-day tables, corrected with every batch of raw rows.

    Each batch settles the earliest row per id against the kept events, recomputes the
    player-days and dungeon-days of the (day, server) pairs it changes, and from these
    the metric rows; what no longer exists is deleted. The result is that of the batch
    layers in any order of arrival, but for null servers: these can't be a key, so they
    only count in the recharge total. That comes from a table of paying players, of
    which a batch changes only its own players' rows.

    Events are put in force last, so that a batch replayed after a crash at any point
    finds the same change and retracts the same rows; finished tables skip it.
    """

    COLUMNS = "event_id string, event_type string, event_time timestamp, player_id bigint, role_id bigint, server_id int, session_id string, payload string"
    COUNTS = ", ".join(f"{c} bigint" for c in ("event_cnt", "session_cnt", "login_cnt", "logout_cnt", "enter_dungeon_cnt", "clear_dungeon_cnt", "death_cnt", "recharge_cnt", "recharge_fen", "online_sec_sum"))
    TABLES = {
        "dws_player_behavior_di": f"dt date, server_id int, player_id bigint, {COUNTS}, first_event_time timestamp, last_event_time timestamp",
        "dws_dungeon_behavior_di": "dt date, server_id int, dungeon_id int, enter_cnt bigint, clear_cnt bigint, death_cnt bigint",
        "ads_dau_di": "dt date, server_id int, dau bigint, metric_id string",
        "ads_pay_rate_di": "dt date, server_id int, dau bigint, pay_users bigint, pay_rate double, metric_id string",
        "ads_arpu_di": "dt date, server_id int, dau bigint, revenue_cny double, arpu_cny double, metric_id string",
        "ads_online_duration_di": "dt date, server_id int, total_online_sec bigint, players bigint, avg_online_sec double, metric_id string",
        "ads_dungeon_clear_rate_di": "dt date, server_id int, dungeon_id int, enter_cnt bigint, clear_cnt bigint, clear_rate double, metric_id string",
    }
    THIRD = {"dws_player_behavior_di": ["player_id"], "dws_dungeon_behavior_di": ["dungeon_id"], "ads_dungeon_clear_rate_di": ["dungeon_id"]}

    def __init__(self, spark: SparkSession, folder: str, only: Sequence[str] | None = None):
        self.store = EventStore(spark, f"{folder}/kept", self.COLUMNS)
        self.tables = {name: KeyedTable(spark, f"{folder}/{name}", schema, ["dt", "server_id", *self.THIRD.get(name, [])]) for name, schema in self.TABLES.items() if only is None or name in only}
        self.pays = only is None or "recharge" in only
        self.payers = KeyedTable(spark, f"{folder}/payers", "player_id bigint, cnt bigint, fen bigint, bucket int", ["player_id"], part="bucket")
        self.recharges = KeyedTable(spark, f"{folder}/recharge", "agg_key string, recharge_cnt bigint, recharge_sum decimal(18,2), players bigint", ["agg_key"], part="agg_key")

    @property
    def events(self) -> KeyedTable:
        return self.store.events

    @staticmethod
    def _replace(table: KeyedTable, fresh: DataFrame, change: Change) -> None:
        """The table's rows of the touched pairs become ``fresh``."""
        if table.seen(change.batch_id):
            return
        days = [r[0] for r in change.touched.select("dt").distinct().collect()]  # calendar days
        old = table.read(days).join(change.touched, ["dt", "server_id"], "left_semi")
        fresh = fresh.select(*table.schema.names)
        gone = old.join(fresh.select(*table.keys), table.keys, "left_anti")
        table.merge(fresh.withColumn("op", F.lit("upsert")).unionByName(gone.withColumn("op", F.lit("delete"))), change.batch_id)

    def _pay(self, change: Change, buckets: int = 64) -> None:
        """Payers' counts and amounts, changed by the rows that enter and leave; the total is read off them."""
        signed = flatten(change.entering.withColumn("_sign", F.lit(1)).unionByName(change.leaving.withColumn("_sign", F.lit(-1))).where("event_type = 'recharge'"))
        delta = signed.where("amount_fen IS NOT NULL").groupBy("player_id").agg(F.sum("_sign").alias("_c"), F.sum(F.col("_sign") * F.col("amount_fen")).alias("_f"))
        bucket = F.pmod(F.xxhash64("player_id"), F.lit(buckets)).cast("int")
        if not self.payers.seen(change.batch_id):
            whole = delta.join(self.payers.read().drop("bucket"), "player_id", "left")
            fresh = whole.select("player_id", (F.coalesce("cnt", F.lit(0)) + F.col("_c")).alias("cnt"), (F.coalesce("fen", F.lit(0)) + F.col("_f")).alias("fen"), bucket.alias("bucket"))
            self.payers.merge(fresh.withColumn("op", F.when(F.col("cnt") > 0, "upsert").otherwise("delete")), change.batch_id)
        total = self.payers.read().agg(F.sum("cnt").alias("n"), F.sum("fen").alias("f"), F.count("*").alias("players"))
        amount = (F.col("f").cast("decimal(20,2)") / F.lit(100)).cast("decimal(18,2)")
        row = total.where("players > 0").select(F.lit("recharge_total").alias("agg_key"), F.col("n").alias("recharge_cnt"), amount.alias("recharge_sum"), "players")
        self.recharges.merge(row.withColumn("op", F.lit("upsert")), change.batch_id)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.store.events.seen(batch_id):
            return
        raw = valid_events(batch.select(*(c for c in ODS_COLUMNS if c not in PROMOTED))).drop("dt").withColumn("event_time", F.col("event_time").cast("timestamp"))
        change = self.store.settle(raw, batch_id)
        # one parse and one aggregation for all tables; null servers are no keys
        dwd = flatten(self.store.after(change).where("server_id IS NOT NULL"))
        days, dungeons = player_day(dwd).persist(), dungeon_day(dwd).persist()
        paired = replace(change, touched=change.touched.where("server_id IS NOT NULL"))
        fresh = {"dws_player_behavior_di": days, "dws_dungeon_behavior_di": dungeons, "ads_dungeon_clear_rate_di": metrics.dungeon_clear_rate(dungeons)}
        fresh |= {"ads_dau_di": metrics.dau(days), "ads_pay_rate_di": metrics.pay_rate(days), "ads_arpu_di": metrics.arpu(days), "ads_online_duration_di": metrics.online_duration(days)}
        with ThreadPoolExecutor(8) as pool:  # the tables don't depend on each other
            jobs = [pool.submit(self._replace, table, fresh[name], paired) for name, table in self.tables.items()]
            for job in [*jobs, *([pool.submit(self._pay, change)] if self.pays else [])]:
                job.result()
        for df in (days, dungeons):
            df.unpersist()
        self.store.commit(change)


class ExactGauge:
    """Daily gauge (DAU, payers, pay rate) in exact first-wins mode: a replay with an earlier time moves the event to its day.

    The same way of working as ``LiveMetrics``, for events without a payload: the gauges
    of the changed (day, server) pairs are recomputed from the kept events and
    published first, the events last. Null servers can't be a key and are left out.
    """

    COLUMNS = "event_id string, event_type string, event_time timestamp, player_id bigint, server_id int"

    def __init__(self, spark: SparkSession, folder: str):
        self.store = EventStore(spark, f"{folder}/kept", self.COLUMNS)
        self.gauge = KeyedTable(spark, f"{folder}/gauge", GAUGE, ["dt", "server_id"])

    @property
    def events(self) -> KeyedTable:
        return self.store.events

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.store.events.seen(batch_id):
            return
        new = valid_events(batch).where("server_id IS NOT NULL").withColumn("event_time", F.col("event_time").cast("timestamp"))
        change = self.store.settle(new, batch_id)
        base = reports.event_pay_rate(self.store.after(change))
        LiveMetrics._replace(self.gauge, base, change)
        self.store.commit(change)


def supervise(start: Callable[[], StreamingQuery], attempts: int = 10, delay: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a query to its end; on failure start it again from its checkpoint after a fixed delay. Returns the restarts."""
    for restart in range(attempts + 1):
        try:
            start().awaitTermination()
            return restart
        except Exception:
            if restart == attempts:
                raise
            sleep(delay)
    return attempts
