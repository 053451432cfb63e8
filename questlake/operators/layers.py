"""Cleaning (ODS to DWD) and the three aggregate tables (DWS)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from questlake.schema import DWD_COLUMNS, EVENT_TYPES, PROMOTED
from questlake.sources.ods import flatten

#: Columns that settle, in this order, which of several rows with one id and one time is kept.
TIE_BREAK = ("player_id", "server_id", "event_type", "session_id", "role_id", "payload")
#: Enough of them where only time, player and server of the kept row are used: the rest is then neither read nor shuffled.
KEYS_ONLY = TIE_BREAK[:2]


def valid_events(ods: DataFrame) -> DataFrame:
    """Rows with an id, a time, a positive player and one of the eleven types; adds dt."""
    kept = ods.where(
        F.col("event_id").isNotNull()
        & F.col("event_type").isin(*EVENT_TYPES)
        & F.col("player_id").isNotNull()
        & (F.col("player_id") > 0)
        & F.col("event_time").isNotNull()
    )
    return kept.withColumn("dt", F.to_date("event_time"))


def first_wins(events: DataFrame, key: str = "event_id", order: str = "event_time", ties: tuple[str, ...] = TIE_BREAK) -> DataFrame:
    """One row per key: the earliest, ties by the other columns (nulls last).

    The row-number filter lets the planner cut each key to one row before the shuffle,
    so an id that is repeated without end still sends one row a task.
    """
    rest = [F.col(c).asc_nulls_last() for c in ties if c in events.columns]
    w = W.partitionBy(key).orderBy(F.col(order).asc_nulls_last(), *rest)
    return events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clean(ods: DataFrame) -> DataFrame:
    """DWD: valid events, one row per event id."""
    return first_wins(valid_events(ods)).select(*(c for c in DWD_COLUMNS if c in ods.columns or c == "dt"))


def clean_raw(raw: DataFrame, ties: tuple[str, ...] = TIE_BREAK) -> DataFrame:
    """``clean`` from rows whose payload isn't read yet: the JSON is parsed after de-duplication, for surviving rows only.

    A caller that uses no column beyond a prefix of TIE_BREAK may give that prefix: the
    used columns come out the same, and the scan is narrower.
    """
    bare = raw.drop(*PROMOTED)
    return flatten(first_wins(valid_events(bare), ties=ties)).select(*DWD_COLUMNS)


def _is(kind: str) -> F.Column:
    return F.count_if(F.col("event_type") == kind)


def player_day(dwd: DataFrame) -> DataFrame:
    """One row per day, server and player with activity."""
    return dwd.groupBy("dt", "server_id", "player_id").agg(
        F.count("*").alias("event_cnt"),
        F.countDistinct("session_id").alias("session_cnt"),
        _is("login").alias("login_cnt"),
        _is("logout").alias("logout_cnt"),
        _is("enter_dungeon").alias("enter_dungeon_cnt"),
        _is("clear_dungeon").alias("clear_dungeon_cnt"),
        _is("death").alias("death_cnt"),
        _is("recharge").alias("recharge_cnt"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "recharge", F.col("amount_fen"))), F.lit(0)).cast("bigint").alias("recharge_fen"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "logout", F.col("online_sec"))), F.lit(0)).cast("bigint").alias("online_sec_sum"),
        F.min("event_time").alias("first_event_time"),
        F.max("event_time").alias("last_event_time"),
    )


def dungeon_day(dwd: DataFrame) -> DataFrame:
    """One row per day, server and dungeon that any event names."""
    return (
        dwd.where(F.col("dungeon_id").isNotNull())
        .groupBy("dt", "server_id", "dungeon_id")
        .agg(_is("enter_dungeon").alias("enter_cnt"), _is("clear_dungeon").alias("clear_cnt"), _is("death").alias("death_cnt"))
    )


def first_seen(dwd: DataFrame) -> DataFrame:
    """First observed day and time per player and server (activity, not registration)."""
    return dwd.groupBy("player_id", "server_id").agg(F.min("dt").alias("first_dt"), F.min("event_time").alias("first_event_time"))
