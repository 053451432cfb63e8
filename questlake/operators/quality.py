"""Conformance of raw events with the envelope and the per-type payload rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questlake.schema import EVENT_TYPES, REQUIRED_PAYLOAD

REQUIRED = ("event_id", "event_type", "event_time", "player_id", "role_id", "server_id", "session_id")


def violations(ods: DataFrame) -> DataFrame:
    """Event rows that break a rule: event_id, event_type, event_time and the first broken rule as `reason`.

    Rules in order: the seven envelope fields are present, the type is one of the
    eleven, player and server are at least 1, the role at least 0, and the field that
    the type's payload must carry is there (an amount at least 1).
    """
    reason = None
    for name in REQUIRED:
        test = F.col(name).isNull()
        reason = F.when(test, f"no {name}") if reason is None else reason.when(test, f"no {name}")
    reason = reason.when(~F.col("event_type").isin(*EVENT_TYPES), "unknown type")
    reason = reason.when((F.col("player_id") < 1) | (F.col("server_id") < 1) | (F.col("role_id") < 0), "number too small")
    for kind, name in REQUIRED_PAYLOAD.items():
        reason = reason.when((F.col("event_type") == kind) & F.col(name).isNull(), f"no {name} in payload")
    reason = reason.when((F.col("event_type") == "recharge") & (F.col("amount_fen") < 1), "amount too small")
    return ods.select("event_id", "event_type", "event_time", reason.alias("reason")).where("reason IS NOT NULL")
