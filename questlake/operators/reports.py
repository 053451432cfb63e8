"""Reports and single-purpose queries over the layers and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from questlake.functions.scalars import micros, ratio


def dau_by_day(dau: DataFrame) -> DataFrame:
    """Sum of the servers' DAU by day (a player on two servers counts twice)."""
    return dau.groupBy("dt").agg(F.sum("dau").alias("dau_all"))


def pay_arpu(pay_rate: DataFrame, arpu: DataFrame) -> DataFrame:
    joined = pay_rate.select("dt", "server_id", "pay_rate").join(arpu.select("dt", "server_id", "arpu_cny"), ["dt", "server_id"])
    return joined.agg(F.round(F.avg("pay_rate"), 4).alias("avg_pay_rate"), F.round(F.avg("arpu_cny"), 4).alias("avg_arpu"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_cnt")).select(F.lit(name).alias("table_name"), "row_cnt")
        out = one if out is None else out.union(one)
    return out


def dau_lookup(dau: DataFrame) -> DataFrame:
    """Published rows with positive DAU, in reading order."""
    return dau.where((F.col("metric_id") == "ads_dau_di") & (F.col("dau") > 0)).orderBy("dt", "server_id")


def serving_row(dau: DataFrame, pay_rate: DataFrame) -> DataFrame:
    """One text row per key with `NULL` for a missing side."""
    keys = ["dt", "server_id"]
    joined = dau.select(*keys, "dau").join(pay_rate.select(*keys, "pay_users"), keys, "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    return joined.select(*keys, F.concat_ws("|", text("dau"), text("pay_users")).alias("serving_row"))


def bounded_dau(valid: DataFrame) -> DataFrame:
    """DAU straight from valid events without de-duplication (distinct counts don't need it)."""
    return valid.groupBy("dt", "server_id").agg(F.countDistinct("player_id").alias("dau")).withColumn("metric_id", F.lit("ads_dau_di"))


def event_pay_rate(valid: DataFrame) -> DataFrame:
    """Event-level pay rate: distinct payers over distinct players.

    Two levels (player, then day) instead of two distinct counts, which would double
    the rows before the shuffle.
    """
    players = valid.groupBy("dt", "server_id", "player_id").agg(F.max(F.when(F.col("event_type") == "recharge", 1).otherwise(0)).alias("_p"))
    base = players.groupBy("dt", "server_id").agg(F.count("*").alias("dau"), F.sum("_p").alias("pay_users"))
    return base.withColumn("pay_rate", F.when(F.col("dau") != 0, F.col("pay_users").cast("double") / F.col("dau")))


def player_activity_days(player_day: DataFrame) -> DataFrame:
    return player_day.select("player_id", "server_id", "dt").distinct()


def recharge_total(dwd: DataFrame) -> DataFrame:
    """Continuous recharge gauge keyed by a constant: count, DECIMAL sum and players."""
    paid = dwd.where((F.col("event_type") == "recharge") & F.col("amount_fen").isNotNull())
    return paid.groupBy(F.lit("recharge_total").alias("agg_key")).agg(
        F.count("*").alias("recharge_cnt"),
        F.sum((F.col("amount_fen").cast("decimal(18,2)") / F.lit(100)).cast("decimal(18,2)")).cast("decimal(18,2)").alias("recharge_sum"),
        F.countDistinct("player_id").alias("players"),
    )


def minute_windows(events: DataFrame) -> DataFrame:
    """Tumbling minutes: distinct event ids and players."""
    w = F.window("event_time", "1 minute")
    return events.groupBy(w.alias("w")).agg(F.countDistinct("event_id").alias("event_cnt"), F.countDistinct("player_id").alias("player_cnt")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_cnt", "player_cnt"
    )


def player_day_tumble(dwd: DataFrame) -> DataFrame:
    """Day windows per server and player with the streaming layer's measures."""
    count = lambda kind: F.count_if(F.col("event_type") == kind).alias(f"{kind}_cnt")
    total = lambda kind, c: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col(c).cast("bigint"))), F.lit(0).cast("bigint"))
    days = dwd.groupBy(F.window("event_time", "1 day").alias("w"), "server_id", "player_id").agg(
        F.count("*").alias("event_cnt"), count("login"), count("enter_dungeon"), count("clear_dungeon"), count("recharge"),
        total("recharge", "amount_fen").alias("recharge_fen"), total("logout", "online_sec").alias("online_sec_sum"),
    )
    rest = [c for c in days.columns if c != "w"]
    return days.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.to_date("w.start").alias("dt"), *rest)


def dungeon_day_tumble(dwd: DataFrame) -> DataFrame:
    """Clear rate in day windows per server and dungeon, for events that name one."""
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    days = dwd.where("dungeon_id IS NOT NULL").groupBy(F.window("event_time", "1 day").alias("w"), "server_id", "dungeon_id")
    counts = days.agg(count("enter_dungeon").alias("enter_cnt"), count("clear_dungeon").alias("clear_cnt"))
    rate = ratio(F.col("clear_cnt"), F.col("enter_cnt")).alias("clear_rate")
    return counts.select(F.to_date("w.start").alias("dt"), "server_id", "dungeon_id", "enter_cnt", "clear_cnt", rate, F.lit("ads_dungeon_clear_rate_di").alias("metric_id"))


def latest_by_key(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key in an upsert log; a record of nulls deletes the key."""
    rest = [c for c in changes.columns if c not in keys and c not in order]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return last.where(F.col("_v").isNotNull()).select(*keys, "_v.*")


def nearest_ranks(values: DataFrame, value: str, ranks: dict[str, Column], ranges: int = 64) -> DataFrame:
    """One row: for each named rank (a Column over the number of values `n`, counted from 1) the value there; null if there are none.

    Values are counted by value and fall into ranges between approximate percentiles (a
    few dozen numbers). A rank is found by the number of values in the ranges before
    and a running count within its own range, so no task holds all the distinct values.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    borders = sorted(set(counts.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)])).first()[0] or []))
    place = F.size(F.filter(F.array(*map(F.lit, borders)), lambda x: x < F.col("v"))) if borders else F.lit(0)
    laid = counts.withColumn("_range", place)
    sums = laid.groupBy("_range").agg(F.sum("c").alias("c"))  # a row a range
    whole = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = sums.select("_range", (F.sum("c").over(W.orderBy("_range")) - F.col("c")).alias("_before"), F.sum("c").over(whole).alias("n"))
    upto = F.sum("c").over(W.partitionBy("_range").orderBy("v")) + F.col("_before")
    run = laid.join(F.broadcast(before), "_range").withColumn("upto", upto)
    return run.agg(*(F.min(F.when(F.col("upto") >= rank, F.col("v"))).alias(name) for name, rank in ranks.items()))


def latency_percentiles(rows: DataFrame, start: str = "produce_ts", end: str = "sink_ts") -> DataFrame:
    """Nearest-rank p50/p95/p99, average, extremes and negatives of end - start in ms; missing times don't count."""
    us = micros(F.col(end)) - micros(F.col(start))
    base = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(us.alias("us"))
    ms = lambda c: (c / F.lit(1000.0))
    plain = base.agg(
        F.count("*").alias("n"), F.round(ms(F.sum("us")) / F.count("*"), 3).alias("avg_ms"), ms(F.min("us")).alias("min_ms"), ms(F.max("us")).alias("max_ms"),
        F.count_if(F.col("us") < 0).alias("negative_cnt"),
    )
    at = nearest_ranks(base, "us", {f"p{p}_ms": F.ceil(F.col("n") * p / 100) for p in (50, 95, 99)})
    both = plain.crossJoin(at.select(*(ms(F.col(c)).alias(c) for c in at.columns)))  # one row each
    return both.select("n", "avg_ms", "p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms", "negative_cnt")


def duration_stats(rows: DataFrame, value: str) -> DataFrame:
    """Count, average, upper median (the n div 2-th from 0), nearest-rank p95 and extremes of durations."""
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    plain = known.agg(F.count("*").alias("n"), F.round(F.sum("v") / F.count("*"), 2).alias("avg_ms"), F.min("v").alias("min_ms"), F.max("v").alias("max_ms"))
    at = nearest_ranks(known, "v", {"p50_ms": F.floor(F.col("n") / 2) + 1, "p95_ms": F.ceil(F.col("n") * 0.95)})
    return plain.crossJoin(at).select("n", "avg_ms", "p50_ms", "p95_ms", "min_ms", "max_ms")  # one row each


def clock_skew(rows: DataFrame, sender: str, sent: str, received: str) -> DataFrame:
    """Per sender, in ms: the least, and the upper bound of how far its clock is ahead; null if it had no pair of times.

    A record can't arrive before it was sent, so received - sent below zero is what the
    sender's clock is ahead at least.
    """
    ms = (micros(F.col(received)) - micros(F.col(sent))) / F.lit(1000.0)
    return rows.groupBy(sender).agg(F.count(ms).alias("pairs"), F.min(ms).alias("least_ms"), F.greatest(-F.min(ms), F.lit(0.0)).alias("ahead_ms"))
