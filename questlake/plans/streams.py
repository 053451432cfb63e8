"""Streaming queries run to the end of their input, and the batch SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlake.functions.scalars import promoted
from questlake.operators import metrics
from questlake.operators.keyed_table import KeyedTable
from questlake.operators.layers import clean_raw, valid_events
from questlake.plans.core_sql import VALID
from questlake.schema import PROMOTED, STREAM_EVENT
from questlake.sources.ods import flatten, stream_ndjson, table
from questlake.sources.topic import publish
from questlake.streaming import jobs, observe
from questlake.workspace import materialise, new_folder


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # as a pattern, since a plain path must be a folder for the streaming reader
    rows = spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")
    return rows.withColumn("event_time", F.col("event_time").cast("timestamp"))


def _append(df: DataFrame, folder: str) -> DataFrame:
    spark = df.sparkSession
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def stream_daily_gauge(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "gauge")
    target = KeyedTable(spark, f"{folder}/table", jobs.GAUGE, ["dt", "server_id"])
    gauge = jobs.daily_gauge(_stream(spark, d, "kafka_g3_events").where("server_id IS NOT NULL"))
    jobs.to_keyed(gauge, target, f"{folder}/checkpoint").awaitTermination()
    return target.read()


def stream_recharge_agg(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "recharge")
    target = KeyedTable(spark, f"{folder}/table", "agg_key string, recharge_cnt bigint, recharge_sum decimal(18,2), players bigint", ["agg_key"], part="agg_key")
    fen = promoted(F.col("amount_fen"), F.col("payload"), "amount_fen", "bigint")
    rows = _stream(spark, d, "ods_player_events").withColumn("amount", (fen / F.lit(100)).cast("decimal(18,2)"))
    jobs.to_keyed(jobs.recharge_gauge(rows), target, f"{folder}/checkpoint").awaitTermination()
    return target.read()


def stream_window_1m(spark: SparkSession, d: str) -> DataFrame:
    out = _append(jobs.minute_windows(_stream(spark, d, "kafka_g3_events")), new_folder(spark, "minutes"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


def stream_ods_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten(_stream(spark, d, "ods_player_events"))
    out = _append(valid_events(rows).drop("payload"), new_folder(spark, "clean"))
    return out.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def stream_exact_gauge(spark: SparkSession, d: str) -> DataFrame:
    """Daily gauge by keyed merge with retraction."""
    folder = new_folder(spark, "exact")
    gauge = jobs.ExactGauge(spark, folder)
    rows = _stream(spark, d, "kafka_g3_events")
    rows.writeStream.foreachBatch(gauge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return gauge.gauge.read()


def _in_parts(spark: SparkSession, d: str, name: str, folder: str, parts: int = 2) -> DataFrame:
    """The whole table as a stream of ``parts`` files, one a micro-batch."""
    rows = table(spark, d, name)
    materialise(rows.withColumn("event_time", F.col("event_time").cast("timestamp")).repartition(parts), f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def _clean_stream(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """Clean events as a stream."""
    rows = clean_raw(table(spark, d, "ods_player_events"))
    schema = materialise(rows.withColumn("event_time", F.col("event_time").cast("timestamp")), f"{folder}/dwd").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/dwd")


def stream_player_day_windows(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "player-days")
    return _ntz(_append(jobs.player_day_windows(_clean_stream(spark, d, folder)), folder))


def stream_dungeon_day_windows(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "dungeon-days")
    return _append(jobs.dungeon_day_windows(_clean_stream(spark, d, folder)), folder)


def stream_chain(spark: SparkSession, d: str) -> DataFrame:
    """Three stages with a folder and a checkpoint each: raw to clean events, to closed player-days, to DAU by key."""
    folder = new_folder(spark, "chain")
    stage = lambda df, name: spark.readStream.schema(_append(df, f"{folder}/{name}").schema).parquet(f"{folder}/{name}/out")
    clean = stage(jobs.clean_stream(flatten(_stream(spark, d, "ods_player_events").drop(*PROMOTED))).drop("payload"), "clean")
    days = stage(jobs.player_day_windows(clean.where("server_id IS NOT NULL")), "days")
    target = KeyedTable(spark, f"{folder}/dau", "dt date, server_id int, dau bigint, metric_id string", ["dt", "server_id"])
    jobs.to_keyed(metrics.dau(days), target, f"{folder}/dau-checkpoint").awaitTermination()
    return target.read()


def _live(spark: SparkSession, d: str, only: list[str] | None = None) -> jobs.LiveMetrics:
    """The live job over two micro-batches in an order that isn't that of time."""
    folder = new_folder(spark, "live")
    live = jobs.LiveMetrics(spark, folder, only)
    rows = _in_parts(spark, d, "ods_player_events", folder)
    rows.writeStream.foreachBatch(live).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return live


#: The measures of the live metrics in one long form.
LIVE = {
    "ads_dau_di": ("dau",), "ads_pay_rate_di": ("pay_users", "pay_rate"), "ads_arpu_di": ("revenue_cny", "arpu_cny"),
    "ads_online_duration_di": ("total_online_sec", "players", "avg_online_sec"), "ads_dungeon_clear_rate_di": ("enter_cnt", "clear_cnt", "clear_rate"),
}


def live_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Five metrics out of one stream: metric_id, dt, server_id, dungeon_id, measure, value."""
    live, out = _live(spark, d, list(LIVE)), None
    for name, measures in LIVE.items():
        dungeon = F.col("dungeon_id") if name == "ads_dungeon_clear_rate_di" else F.lit(None).cast("int")
        each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures)))
        one = live.tables[name].read().select("metric_id", "dt", "server_id", dungeon.alias("dungeon_id"), each.alias("m")).select("metric_id", "dt", "server_id", "dungeon_id", "m.*")
        out = one if out is None else out.unionByName(one)
    return out


def live_player_day(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(_live(spark, d, ["dws_player_behavior_di"]).tables["dws_player_behavior_di"].read())


def live_recharge(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d, ["recharge"]).recharges.read()


def stream_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """Stamped rows; the stamp itself is of this run, so it is told as being there."""
    rows = jobs.passthrough(_stream(spark, d, "kafka_g3_events").drop("sink_ts", "tag"))
    return _ntz(_append(rows.withColumn("stamped", F.col("sink_ts").isNotNull()).drop("sink_ts"), new_folder(spark, "through")))


def stream_topic(spark: SparkSession, d: str) -> DataFrame:
    """Events published as JSON-lines segments and consumed a segment at a time."""
    folder = new_folder(spark, "topic")
    names = [f.name for f in STREAM_EVENT]
    publish(table(spark, d, "kafka_g3_events").select(names), f"{folder}/in")
    return _ntz(_append(stream_ndjson(spark, f"{folder}/in", STREAM_EVENT, files_per_trigger=1), folder))


def stream_restarts(spark: SparkSession, d: str) -> DataFrame:
    """The daily gauge over three starts from one checkpoint, the first of which fails to come up; each finds new files."""
    folder = new_folder(spark, "restarts")
    rows = table(spark, d, "kafka_g3_events").where("server_id IS NOT NULL").withColumn("event_time", F.col("event_time").cast("timestamp"))
    target = KeyedTable(spark, f"{folder}/table", jobs.GAUGE, ["dt", "server_id"])
    for k in range(3):
        rows.where(F.pmod(F.xxhash64("event_id", "event_time"), F.lit(3)) == k).write.mode("append").parquet(f"{folder}/in")
        failures = [OSError("worker lost")] if k == 0 else []

        def start():
            if failures:
                raise failures.pop()
            events = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            return jobs.to_keyed(jobs.daily_gauge(events), target, f"{folder}/checkpoint")

        jobs.supervise(start, delay=0.1)
    return target.read()


def stream_dedup_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Each identifier once, with state bounded by the watermark."""
    clean = jobs.clean_stream(_stream(spark, d, "kafka_g3_events"), horizon=True)
    return _append(clean.select("event_id"), new_folder(spark, "horizon"))


# The twelve-row disorder fixture (id, type, seconds after 10:00:00, player), delivered in three phases.
DISORDER = (
    (("in-01", "login", 5, 1001), ("in-02", "login", 15, 1002), ("in-03", "enter_dungeon", 25, 1003), ("ooo-hi", "login", 30, 1004), ("ooo-lo", "login", 27, 1005), ("dup-01", "recharge", 35, 1006), ("dup-01", "recharge", 35, 1006), ("in-04", "logout", 50, 1007), ("w2-01", "login", 70, 2001)),
    (("late-01", "login", 40, 9001),),
    (("w2-02", "login", 80, 2002), ("w2-close", "login", 130, 3001)),
)


def stream_late_drop(spark: SparkSession, d: str) -> DataFrame:
    """Minute windows of the disorder fixture: the late row for a closed window is dropped."""
    folder = new_folder(spark, "disorder")
    start = F.lit("2026-09-07 10:00:00").cast("timestamp")
    for k, phase in enumerate(DISORDER):
        rows = spark.createDataFrame(list(phase), "event_id string, event_type string, s int, player_id bigint")
        rows.select("event_id", "event_type", (start + F.make_dt_interval(secs=F.col("s"))).alias("event_time"), "player_id").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        events = spark.readStream.schema("event_id string, event_type string, event_time timestamp, player_id bigint").parquet(f"{folder}/in")
        out = _append(jobs.minute_windows(events), folder)
    return _ntz(out)


def stream_measures(spark: SparkSession, d: str) -> DataFrame:
    """What a stream's own progress tells: rows read, whether durations and a rate were measured, and why the lag wasn't."""
    folder = new_folder(spark, "measures")
    rows = jobs.passthrough(_in_parts(spark, d, "kafka_g3_events", folder))
    q = rows.writeStream.format("noop").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    told = observe.report(q)
    read = sum(p.get("numInputRows", 0) for p in observe._progress(q))
    row = (read, "avg" in told["batches"] and told["batches"]["n"] >= 2, "avg" in told["throughput"], told["pressure"]["level"] in ("ok", "low", "high"), told["lag"]["missing"])
    return spark.createDataFrame([row], "input_rows bigint, has_durations boolean, has_rate boolean, has_pressure boolean, lag_missing string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stream_daily_gauge": stream_daily_gauge,
        "stream_recharge_agg": stream_recharge_agg,
        "stream_window_1m": stream_window_1m,
        "stream_ods_clean": stream_ods_clean,
        "stream_exact_gauge": stream_exact_gauge,
        "stream_player_day_windows": stream_player_day_windows,
        "stream_dungeon_day_windows": stream_dungeon_day_windows,
        "stream_chain": stream_chain,
        "stream_passthrough": stream_passthrough,
        "stream_topic": stream_topic,
        "stream_restarts": stream_restarts,
        "stream_dedup_horizon": stream_dedup_horizon,
        "stream_late_drop": stream_late_drop,
        "stream_measures": stream_measures,
        "live_metrics": live_metrics,
        "live_player_day": live_player_day,
        "live_recharge": live_recharge,
    }


def oracle_sql() -> dict[str, str]:
    from questlake.plans import core_sql as sql

    _TYPES = sql._TYPES
    at_server = lambda q: f"SELECT * FROM ({q}) WHERE server_id IS NOT NULL"
    closed = lambda q, source, more="TRUE": f"SELECT * FROM ({q}) WHERE dt + 1 <= (SELECT MAX(event_time) FROM {source} WHERE {more}) - INTERVAL 10 SECOND"
    bodies = {"ads_dau_di": sql.DAU, "ads_pay_rate_di": sql.PAY, "ads_arpu_di": sql.ARPU, "ads_online_duration_di": sql.ONLINE, "ads_dungeon_clear_rate_di": sql.CLEAR}
    long_form = [
        f"SELECT metric_id, dt, server_id, {'dungeon_id' if name == 'ads_dungeon_clear_rate_di' else 'CAST(NULL AS INTEGER)'} AS dungeon_id, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({at_server(bodies[name])})"
        for name, measures in LIVE.items()
        for m in measures
    ]
    first = f"""SELECT * FROM (SELECT *, CAST(event_time AS DATE) AS dt, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY event_time, player_id, server_id) AS rn FROM kafka_g3_events
      WHERE event_id IS NOT NULL AND event_time IS NOT NULL AND player_id > 0 AND server_id IS NOT NULL AND event_type IN ({_TYPES})) t WHERE rn = 1"""
    gauge = f"""SELECT dt, server_id, COUNT(DISTINCT player_id) AS dau, COUNT(DISTINCT CASE WHEN event_type = 'recharge' THEN player_id END) AS pay_users,
      CAST(COUNT(DISTINCT CASE WHEN event_type = 'recharge' THEN player_id END) AS DOUBLE) / COUNT(DISTINCT player_id) AS pay_rate FROM ({first}) GROUP BY dt, server_id"""
    return {
        # copies of an id fall on one day in these tables, so first arrival and first time agree
        "stream_daily_gauge": gauge,
        "stream_exact_gauge": gauge,
        "stream_recharge_agg": """SELECT 'recharge_total' AS agg_key, COUNT(*) AS recharge_cnt, CAST(SUM(CAST(amount_fen AS DECIMAL(18,2)) / 100) AS DECIMAL(18,2)) AS recharge_sum, COUNT(DISTINCT player_id) AS players FROM (
          SELECT event_id, ANY_VALUE(amount) AS amount_fen, ANY_VALUE(player_id) AS player_id FROM (
            SELECT *, COALESCE(amount_fen, TRY_CAST(json_extract_string(payload, '$.amount_fen') AS BIGINT)) AS amount FROM ods_player_events)
          WHERE event_id IS NOT NULL AND event_type = 'recharge' AND player_id IS NOT NULL AND amount IS NOT NULL GROUP BY event_id)""",
        "stream_window_1m": """WITH e AS (SELECT * FROM kafka_g3_events WHERE event_id IS NOT NULL AND player_id IS NOT NULL AND event_time IS NOT NULL)
          SELECT time_bucket(INTERVAL 1 MINUTE, event_time) AS window_start, time_bucket(INTERVAL 1 MINUTE, event_time) + INTERVAL 1 MINUTE AS window_end,
          COUNT(DISTINCT event_id) AS event_cnt, COUNT(DISTINCT player_id) AS player_cnt FROM e GROUP BY 1, 2
          HAVING time_bucket(INTERVAL 1 MINUTE, ANY_VALUE(event_time)) + INTERVAL 1 MINUTE <= (SELECT MAX(event_time) FROM e) - INTERVAL 5 SECOND""",
        "stream_ods_clean": f"WITH {VALID} SELECT * EXCLUDE (payload) FROM valid",
        "stream_player_day_windows": f"WITH {sql.PLAYER_DAY} {closed(sql.PLAYER_TUMBLE, 'dwd')}",
        "stream_dungeon_day_windows": f"WITH {sql.DUNGEON_DAY} {closed(sql.CLEAR, 'dwd', 'dungeon_id IS NOT NULL')}",
        "stream_chain": f"WITH {sql.PLAYER_DAY} {closed(at_server(sql.DAU), 'dwd', 'server_id IS NOT NULL')}",
        "stream_passthrough": "SELECT event_id, event_type, event_time, player_id, server_id, produce_ts, TRUE AS stamped FROM kafka_g3_events WHERE event_id IS NOT NULL AND player_id IS NOT NULL AND produce_ts IS NOT NULL",
        "stream_topic": "SELECT event_id, event_type, event_time, player_id, server_id, tag FROM kafka_g3_events",
        "stream_restarts": gauge,
        "stream_dedup_horizon": f"SELECT DISTINCT event_id FROM kafka_g3_events WHERE event_id IS NOT NULL AND event_time IS NOT NULL AND player_id > 0 AND event_type IN ({_TYPES})",
        "stream_late_drop": """SELECT CAST(s AS TIMESTAMP) AS window_start, CAST(s AS TIMESTAMP) + INTERVAL 1 MINUTE AS window_end, CAST(n AS BIGINT) AS event_cnt, CAST(n AS BIGINT) AS player_cnt
          FROM (VALUES ('2026-09-07 10:00:00', 7), ('2026-09-07 10:01:00', 2)) t(s, n)""",
        "stream_measures": "SELECT COUNT(*) AS input_rows, TRUE AS has_durations, TRUE AS has_rate, TRUE AS has_pressure, 'the source reports no offsets' AS lag_missing FROM kafka_g3_events",
        "live_metrics": f"WITH {sql.PLAYER_DAY}, {sql.DUNGEON_DAY[len(sql.DWD) + 2 :]} " + " UNION ALL ".join(long_form),
        "live_player_day": f"WITH {sql.PLAYER_DAY} {at_server('SELECT * FROM pd_all')}",
        "live_recharge": sql.oracle_sql()["recharge_agg"],
    }
