"""Named core queries: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlake.functions.scalars import event_type_name, iso_timestamp, promoted
from questlake.operators import features, id_index, late_events, layers, metrics, quality, reports, rolling, sessions
from questlake.schema import FEATURE_TYPES
from questlake.sources import ods as sources
from questlake.sources.generator import generate_events
from questlake.workspace import materialise, new_folder

Query = Callable[[SparkSession, str], DataFrame]

ODS = "ods_player_events"
DWS = "dws_player_behavior_di"


def ods(spark: SparkSession, d: str) -> DataFrame:
    return sources.flatten(sources.table(spark, d, ODS))


def dwd(spark: SparkSession, d: str) -> DataFrame:
    return layers.clean_raw(sources.table(spark, d, ODS))


def player_day(spark: SparkSession, d: str) -> DataFrame:
    return layers.player_day(dwd(spark, d))


def presence(spark: SparkSession, d: str) -> DataFrame:
    """Player-days for queries that use only day, server and player; the scan has the columns for these."""
    return layers.player_day(layers.clean_raw(sources.table(spark, d, ODS), layers.KEYS_ONLY))


def dungeon_day(spark: SparkSession, d: str) -> DataFrame:
    return layers.dungeon_day(dwd(spark, d))


def ods_json_scan(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes as JSON lines, parsed again by the NDJSON reader's parser."""
    t = sources.table(spark, d, ODS)
    iso = F.concat(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    lines = t.select(F.to_json(F.struct("event_id", "event_type", iso.alias("event_time"), "player_id", "role_id", "server_id", "session_id", "payload")).alias("value"))
    return sources.parse_envelope(lines).drop("payload").withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def iso_ts_parse(spark: SparkSession, d: str) -> DataFrame:
    t = sources.table(spark, d, ODS).where("event_time IS NOT NULL")
    iso = F.concat(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return t.select("event_id", iso_timestamp(iso).cast("timestamp_ntz").alias("parsed_ts"))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    log = sources.table(spark, d, "kafka_ods_player_events").where("player_id IS NOT NULL AND server_id IS NOT NULL")
    return reports.latest_by_key(log.select("player_id", "server_id", "event_type", "event_time", "kafka_partition", "kafka_offset", "batch_id"), ["player_id", "server_id"], ["batch_id", "kafka_partition", "kafka_offset"])


def _kept(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """A table that several metrics read, written once."""
    return materialise(df, new_folder(spark, name))


def ads_row_counts(spark: SparkSession, d: str) -> DataFrame:
    clean = _kept(spark, "dwd", dwd(spark, d))
    return reports.row_counts(metrics.all_metrics(_kept(spark, "days", layers.player_day(clean)), _kept(spark, "dungeons", layers.dungeon_day(clean))))


def row_stream_lag(spark: SparkSession, d: str) -> DataFrame:
    """Consumer lag per partition: end offset of the topic less that of the cleaned table."""
    end = sources.table(spark, d, "kafka_ods_player_events").groupBy("kafka_partition").agg((F.max("kafka_offset") + 1).alias("log_end"))
    done = sources.table(spark, d, "dwd_player_events_clean").groupBy("kafka_partition").agg((F.max("kafka_offset") + 1).alias("committed"))
    return end.join(done, "kafka_partition", "left").select("kafka_partition", "log_end", "committed", (F.col("log_end") - F.coalesce("committed", F.lit(0))).alias("lag"))


def p1_minute_counts(spark: SparkSession, d: str) -> DataFrame:
    figures = late_events.corrected_figures(sources.table(spark, d, "kafka_g3_events"))
    return figures.select("server_id", "window_start", "event_cnt", "player_cnt", "on_time_event_cnt", "late_event_cnt")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    figures = late_events.corrected_figures(sources.table(spark, d, "kafka_g3_events"))
    return figures.where("late_event_cnt > 0").select("server_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"))


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    keys = ["player_id", "server_id", "dt"]
    daily = rolling.latest_versions(sources.table(spark, d, DWS), keys, "last_event_time", ["recharge_fen", "online_sec_sum"])
    return rolling.rolling_totals(daily, keys[:2], "dt", ["recharge_fen", "online_sec_sum"])


def _index(spark: SparkSession, d: str) -> id_index.IdIndex:
    return id_index.build_index({t: sources.table(spark, d, t) for t in ("kafka_ods_player_events", "dwd_player_events_clean")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).duplicates()


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).kept().select("topic", F.lower(F.hex("id")).alias("uuid"), "batch_id", "kafka_partition", "kafka_offset")


def _played(spark: SparkSession, d: str) -> DataFrame:
    return sources.table(spark, d, ODS).where("player_id > 0")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.sessions(_played(spark, d))
    ms = lambda c: F.floor(F.col(c) / F.lit(1000)).cast("bigint")
    return s.select("player_id", ms("start_us").alias("session_start_ms"), ms("end_us").alias("session_end_ms"))


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.sessions(_played(spark, d), event_id="event_id")
    return s.select("player_id", "session_no", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "row_cnt", "event_cnt")


def _feature_store(spark: SparkSession, d: str, parts: int = 2) -> features.FeatureStore:
    """Vectors of the raw events, maintained over equal spans of event_time (rows without a time come first)."""
    t = _played(spark, d)
    events = t.select(
        "event_id", "player_id", "event_time", event_type_name(F.col("event_type")).alias("event_type"),
        promoted(F.col("amount_fen"), F.col("payload"), "amount_fen", "bigint").alias("amount_fen"),
        promoted(F.col("online_sec"), F.col("payload"), "online_sec", "int").alias("online_sec"),
    )
    store = features.FeatureStore(spark, new_folder(spark, "features"), ["amount_fen", "online_sec"], types=FEATURE_TYPES)
    lo, hi = t.agg(F.min(F.to_date("event_time")), F.max(F.to_date("event_time"))).first()
    span = (hi - lo).days + 1 if lo else parts
    cut = lambda k: F.lit(str(lo + dt.timedelta(days=k * span // parts))).cast("timestamp_ntz")
    for k in range(parts if lo else 1):
        mine = F.lit(True) if k == 0 else F.col("event_time") >= cut(k)
        if lo and k < parts - 1:
            mine = mine & ((F.col("event_time") < cut(k + 1)) | (F.col("event_time").isNull() if k == 0 else F.lit(False)))
        store.add(events.where(mine), k, "player_id", "event_type", "event_time", "event_id")
    return store


def p7_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _feature_store(spark, d).named("player_id")


def p7_features(spark: SparkSession, d: str) -> DataFrame:
    return _feature_store(spark, d).table("player_id")


P7_COUNTS = ("event_cnt", "session_cnt", "login_cnt", "logout_cnt", "enter_dungeon_cnt", "clear_dungeon_cnt", "death_cnt", "recharge_cnt", "recharge_fen", "online_sec_sum")


def p7_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts and totals of the player-day table per player, newest version of each day."""
    daily = rolling.latest_versions(sources.table(spark, d, DWS).where("player_id > 0"), ["dt", "server_id", "player_id"], "last_event_time", P7_COUNTS)
    return daily.groupBy("player_id").agg(F.count_distinct("dt").alias("active_days"), F.max("dt").alias("last_dt"), *(F.sum(c).alias(f"{c}_total") for c in P7_COUNTS))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "ods_json_scan": ods_json_scan,
        "ods_flatten": lambda s, d: ods(s, d).select("event_id", "event_type", "event_time", "player_id", "server_id", "dungeon_id", "amount_fen", "online_sec"),
        "iso_ts_parse": iso_ts_parse,
        "ods_violations": lambda s, d: quality.violations(ods(s, d)),
        "ods_clean": lambda s, d: layers.valid_events(ods(s, d)).drop("payload"),
        "dedup_first_wins": lambda s, d: dwd(s, d).drop("payload"),
        "dws_player_behavior_di": player_day,
        "dws_dungeon_behavior_di": dungeon_day,
        "dws_player_first_seen": lambda s, d: layers.first_seen(layers.clean_raw(sources.table(s, d, ODS), layers.KEYS_ONLY)),
        "player_activity_days": lambda s, d: reports.player_activity_days(presence(s, d)),
        "active_7d": lambda s, d: metrics.active_in_trailing(presence(s, d), 7),
        "ads_dau_di": lambda s, d: metrics.dau(presence(s, d)),
        "ads_pay_rate_di": lambda s, d: metrics.pay_rate(player_day(s, d)),
        "ads_arpu_di": lambda s, d: metrics.arpu(player_day(s, d)),
        "ads_online_duration_di": lambda s, d: metrics.online_duration(player_day(s, d)),
        "ads_dungeon_clear_rate_di": lambda s, d: metrics.dungeon_clear_rate(dungeon_day(s, d)),
        "ads_retention_nd": lambda s, d: metrics.retention(presence(s, d)),
        "ads_churn_di": lambda s, d: metrics.churn(presence(s, d)),
        "summary_dau_by_day": lambda s, d: reports.dau_by_day(metrics.dau(presence(s, d))),
        "summary_pay_arpu": lambda s, d: (lambda p: reports.pay_arpu(metrics.pay_rate(p), metrics.arpu(p)))(_kept(s, "days", player_day(s, d))),
        "ads_row_counts": ads_row_counts,
        "serving_dau_lookup": lambda s, d: reports.dau_lookup(metrics.dau(presence(s, d))),
        "serving_ads_row": lambda s, d: (lambda p: reports.serving_row(metrics.dau(p), metrics.pay_rate(p)))(_kept(s, "days", player_day(s, d))),
        "bounded_dau": lambda s, d: reports.bounded_dau(layers.valid_events(ods(s, d))),
        "event_pay_rate": lambda s, d: reports.event_pay_rate(layers.valid_events(ods(s, d))),
        "window_1m_distinct": lambda s, d: reports.minute_windows(sources.table(s, d, "kafka_g3_events").where("event_id IS NOT NULL AND player_id IS NOT NULL AND event_time IS NOT NULL")),
        "player_day_tumble": lambda s, d: reports.player_day_tumble(dwd(s, d)),
        "dungeon_day_tumble": lambda s, d: reports.dungeon_day_tumble(dwd(s, d)),
        "recharge_agg": lambda s, d: reports.recharge_total(dwd(s, d)),
        "upsert_latest_by_key": upsert_latest,
        "latency_percentiles": lambda s, d: reports.latency_percentiles(sources.table(s, d, "kafka_g3_events")),
        "checkpoint_duration_stats": lambda s, d: reports.duration_stats(ods(s, d).where("event_type = 'logout'"), "online_sec"),
        "consumer_lag": row_stream_lag,
        "gen_events": lambda s, d: generate_events(s, events=200_000, players=10_000),
        "p1_found": p1_found,
        "p1_minute_counts": p1_minute_counts,
        "p2_rolling": p2_rolling,
        "p4_found": p4_found,
        "p4_kept": p4_kept,
        "p5_found": p5_found,
        "p5_sessions": p5_sessions,
        "p7_vectors": p7_vectors,
        "p7_features": p7_features,
        "p7_daily_totals": p7_daily_totals,
    }
    return q
