"""Reproducible synthetic player events, made in parallel from row numbers.

Every column is derived from hashes of the row number and the seed, so the same
arguments give the same events on any cluster. The events of a session share player,
server and session id; a session opens with a login and closes with a logout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Relative weights of the event types in the source data.
WEIGHTS = {
    "login": 12,
    "create_role": 1,
    "enter_dungeon": 18,
    "clear_dungeon": 10,
    "death": 8,
    "equip": 7,
    "enhance": 6,
    "recharge": 2,
    "gacha": 5,
    "friend": 3,
    "logout": 12,
}
# Price points in fen and dungeon numbers.
PRICES = (600, 3000, 6800, 9800, 19800, 32800, 64800)
DUNGEONS = (1001, 1020)


def _draw(seed: int, salt: str, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(n) if isinstance(n, int) else n)


def generate_events(spark: SparkSession, events: int = 50_000, players: int = 5_000, servers: int = 3, days: int = 14, seed: int = 42, per_session: int = 8, start: str = "2024-01-01") -> DataFrame:
    """ODS-shaped rows with JSON payloads; event_time is spread over ``days`` from ``start``."""
    base = spark.range(events).withColumn("session", F.floor(F.col("id") / per_session)).withColumn("step", F.pmod("id", F.lit(per_session)))
    by_session = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("session")), F.lit(n))
    total = sum(WEIGHTS.values())
    pick = _draw(seed, "type", total)
    kind, upto = None, 0
    for name, weight in WEIGHTS.items():
        upto += weight
        kind = F.when(pick < upto, name) if kind is None else kind.when(pick < upto, name)
    kind = F.when(F.col("step") == 0, "login").when(F.col("step") == per_session - 1, "logout").otherwise(kind)
    rows = (
        base.withColumn("event_type", kind)
        .withColumn("player_id", by_session("player", players) + 1)
        .withColumn("server_id", (F.pmod(F.xxhash64(F.lit(seed), F.lit("server"), F.col("player_id")), F.lit(servers)) + 1).cast("int"))
        .withColumn("_sec", by_session("start", days * 86_400 - per_session * 120) + F.col("step") * 90 + _draw(seed, "jitter", 60))
        .withColumn("event_time", (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("_sec"))))
        .withColumn("dungeon_id", F.when(F.col("event_type").isin("enter_dungeon", "clear_dungeon", "death"), _draw(seed, "dungeon", DUNGEONS[1] - DUNGEONS[0] + 1) + DUNGEONS[0]).cast("int"))
        .withColumn("amount_fen", F.when(F.col("event_type") == "recharge", F.element_at(F.array(*map(F.lit, PRICES)), (_draw(seed, "price", len(PRICES)) + 1).cast("int"))).cast("bigint"))
        .withColumn("online_sec", F.when(F.col("event_type") == "logout", F.col("step") * 90 + _draw(seed, "online", 600)).cast("int"))
    )
    payload = F.to_json(F.struct("dungeon_id", "amount_fen", "online_sec"))
    return rows.select(
        F.md5(F.concat_ws("-", F.lit(seed), F.col("id"))).alias("event_id"), "event_type", "event_time", "player_id",
        F.when(F.col("event_type") == "create_role", 0).otherwise(F.col("player_id") * 10).cast("bigint").alias("role_id"), "server_id",
        F.concat(F.lit("s"), F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col("session"))), 1, 10)).alias("session_id"), payload.alias("payload"), "dungeon_id", "amount_fen", "online_sec",
    )
