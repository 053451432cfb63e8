"""The seven metrics. Inputs are the DWS tables, whose keys are unique.

A player-day row is unique per (dt, server, player), so distinct players of a day are
a plain count and payers a conditional count: one partial aggregation, one small shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from questlake.functions.scalars import ratio


def dau(player_day: DataFrame) -> DataFrame:
    return player_day.groupBy("dt", "server_id").agg(F.count("*").alias("dau")).withColumn("metric_id", F.lit("ads_dau_di"))


def pay_rate(player_day: DataFrame) -> DataFrame:
    base = player_day.groupBy("dt", "server_id").agg(F.count("*").alias("dau"), F.count_if(F.col("recharge_cnt") > 0).alias("pay_users"))
    return base.withColumn("pay_rate", ratio(F.col("pay_users"), F.col("dau"))).withColumn("metric_id", F.lit("ads_pay_rate_di"))


def arpu(player_day: DataFrame) -> DataFrame:
    base = player_day.groupBy("dt", "server_id").agg(F.count("*").alias("dau"), F.sum("recharge_fen").alias("fen"))
    revenue = F.col("fen").cast("double") / F.lit(100.0)
    return base.select("dt", "server_id", "dau", revenue.alias("revenue_cny"), ratio(revenue, F.col("dau")).alias("arpu_cny"), F.lit("ads_arpu_di").alias("metric_id"))


def online_duration(player_day: DataFrame) -> DataFrame:
    base = player_day.groupBy("dt", "server_id").agg(F.sum("online_sec_sum").alias("total_online_sec"), F.count("*").alias("players"))
    return base.withColumn("avg_online_sec", ratio(F.col("total_online_sec"), F.col("players"))).withColumn("metric_id", F.lit("ads_online_duration_di"))


def dungeon_clear_rate(dungeon_day: DataFrame) -> DataFrame:
    return dungeon_day.select(
        "dt", "server_id", "dungeon_id", "enter_cnt", "clear_cnt",
        ratio(F.col("clear_cnt"), F.col("enter_cnt")).alias("clear_rate"), F.lit("ads_dungeon_clear_rate_di").alias("metric_id"),
    )


def retention(player_day: DataFrame, days: Sequence[int] = (1, 3, 7)) -> DataFrame:
    """Share of a first-day cohort active exactly n days later.

    The first day comes from a window over each player's own days (bounded by the
    calendar), so cohort and return days need no self-join; only complete windows are
    given (the last day of the whole table is at least cohort + n). A null server
    never equals itself, so its cohort shows nobody retained.
    """
    w = W.partitionBy("player_id", "server_id")
    seen = player_day.select("player_id", "server_id", "dt").withColumn("cohort_dt", F.min("dt").over(w))
    after = F.when(F.col("server_id").isNotNull(), F.date_diff("dt", "cohort_dt"))
    cohorts = seen.groupBy("cohort_dt", "server_id").agg(
        F.count_if(F.col("dt") == F.col("cohort_dt")).alias("cohort_size"),
        *(F.count_if(after == n).alias(f"_r{n}") for n in days),
    )
    last = player_day.agg(F.max("dt").alias("_last"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n_days"), F.col(f"_r{n}").alias("retained_cnt")) for n in days)))
    return (
        cohorts.withColumn("_e", each)
        .crossJoin(F.broadcast(last))  # one row
        .where(F.col("_last") >= F.date_add("cohort_dt", F.col("_e.n_days")))
        .select(
            "cohort_dt", "server_id", F.col("_e.n_days").alias("n_days"), "cohort_size", F.col("_e.retained_cnt").alias("retained_cnt"),
            ratio(F.col("_e.retained_cnt"), F.col("cohort_size")).alias("retention_rate"),
            F.lit(True).alias("window_complete"), F.lit("ads_retention_nd").alias("metric_id"),
        )
    )


def active_in_trailing(player_day: DataFrame, days: int = 7) -> DataFrame:
    """Players active in the trailing days of each active (dt, server), with their last active day.

    Each activity day is exploded to the days whose window holds it, so the look-back
    is an aggregation instead of a range self-join.
    """
    active = player_day.where(F.col("server_id").isNotNull()).select("dt", "server_id").distinct()
    asof = player_day.select("server_id", "player_id", F.col("dt").alias("_act"), F.explode(F.sequence("dt", F.date_add("dt", days - 1))).alias("dt"))
    return asof.join(active, ["dt", "server_id"], "left_semi").groupBy("dt", "server_id", "player_id").agg(F.max("_act").alias("last_dt"))


def churn(player_day: DataFrame) -> DataFrame:
    """Among players active in [dt-6, dt], those with no activity in [dt-2, dt]."""
    base = active_in_trailing(player_day, 7).groupBy("dt", "server_id").agg(
        F.count("*").alias("active_7d_users"), F.count_if(F.col("last_dt") < F.date_sub("dt", 2)).alias("churn_risk_users")
    )
    return base.withColumn("churn_risk_rate", ratio(F.col("churn_risk_users"), F.col("active_7d_users"))).withColumn("metric_id", F.lit("ads_churn_di"))


def all_metrics(player_day: DataFrame, dungeon_day: DataFrame) -> dict[str, DataFrame]:
    return {
        "ads_dau_di": dau(player_day),
        "ads_retention_nd": retention(player_day),
        "ads_online_duration_di": online_duration(player_day),
        "ads_pay_rate_di": pay_rate(player_day),
        "ads_arpu_di": arpu(player_day),
        "ads_dungeon_clear_rate_di": dungeon_clear_rate(dungeon_day),
        "ads_churn_di": churn(player_day),
    }
