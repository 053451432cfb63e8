"""Event envelope, layer columns and the metric registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The eleven event types of the source schema, in its order.
EVENT_TYPES = (
    "login",
    "create_role",
    "enter_dungeon",
    "clear_dungeon",
    "death",
    "equip",
    "enhance",
    "recharge",
    "gacha",
    "friend",
    "logout",
)

#: Client telemetry types are named area_action; with the eleven types they are the columns of the feature table (others are added as they turn up).
TELEMETRY_AREAS = ("arena", "guild", "mail", "net", "perf", "pet", "quest", "shop", "tut", "ui", "voice")
TELEMETRY_ACTIONS = (
    "claim", "close", "drop", "end", "expire", "fail", "hint", "load", "open", "pull",
    "push", "retry", "save", "skip", "start", "swap", "sync", "tap", "view", "warn",
)
FEATURE_TYPES = (*EVENT_TYPES, *(f"{area}_{action}" for area in TELEMETRY_AREAS for action in TELEMETRY_ACTIONS))

#: Raw JSON envelope as it arrives; event_time is ISO-8601 text.
ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("player_id", T.LongType()),
        T.StructField("role_id", T.LongType()),
        T.StructField("server_id", T.IntegerType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)

#: Fields promoted from the payload, with their types.
PROMOTED = {"dungeon_id": "int", "amount_fen": "bigint", "online_sec": "int"}

#: Types of event whose payload must carry a field.
REQUIRED_PAYLOAD = {"enter_dungeon": "dungeon_id", "clear_dungeon": "dungeon_id", "recharge": "amount_fen"}

ODS_COLUMNS = (
    "event_id", "event_type", "event_time", "player_id", "role_id", "server_id",
    "session_id", "payload", "dungeon_id", "amount_fen", "online_sec",
)
DWD_COLUMNS = (
    "event_id", "event_type", "event_time", "dt", "player_id", "role_id", "server_id",
    "session_id", "payload", "dungeon_id", "amount_fen", "online_sec",
)

#: Streamed events of the window and gauge jobs.
STREAM_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("player_id", T.LongType()),
        T.StructField("server_id", T.IntegerType()),
        T.StructField("tag", T.StringType()),
    ]
)
RECHARGE_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("player_id", T.LongType()),
        T.StructField("server_id", T.IntegerType()),
        T.StructField("amount", T.DecimalType(18, 2)),
        T.StructField("tag", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Metric:
    metric_id: str
    grain: tuple[str, ...]
    columns: tuple[str, ...]
    realtime: bool


METRICS = {
    m.metric_id: m
    for m in (
        Metric("ads_dau_di", ("dt", "server_id"), ("dt", "server_id", "dau", "metric_id"), True),
        Metric(
            "ads_retention_nd",
            ("cohort_dt", "server_id", "n_days"),
            ("cohort_dt", "server_id", "n_days", "cohort_size", "retained_cnt", "retention_rate", "window_complete", "metric_id"),
            False,
        ),
        Metric(
            "ads_online_duration_di",
            ("dt", "server_id"),
            ("dt", "server_id", "total_online_sec", "players", "avg_online_sec", "metric_id"),
            True,
        ),
        Metric("ads_pay_rate_di", ("dt", "server_id"), ("dt", "server_id", "dau", "pay_users", "pay_rate", "metric_id"), True),
        Metric("ads_arpu_di", ("dt", "server_id"), ("dt", "server_id", "dau", "revenue_cny", "arpu_cny", "metric_id"), True),
        Metric(
            "ads_dungeon_clear_rate_di",
            ("dt", "server_id", "dungeon_id"),
            ("dt", "server_id", "dungeon_id", "enter_cnt", "clear_cnt", "clear_rate", "metric_id"),
            True,
        ),
        Metric(
            "ads_churn_di",
            ("dt", "server_id"),
            ("dt", "server_id", "active_7d_users", "churn_risk_users", "churn_risk_rate", "metric_id"),
            False,
        ),
    )
}

#: Dimensions a metric query may filter or group by.
ALLOWED_DIMS = ("dt", "server_id", "dungeon_id", "n_days", "cohort_dt")
