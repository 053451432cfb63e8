"""Trailing-period totals per entity and calendar day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_versions(rows: DataFrame, keys: Sequence[str], version: str, values: Sequence[str]) -> DataFrame:
    """One row per key: of each value the newest version's that isn't null.

    A repeated row (nulls may differ) and an early version beside a later one both
    come down to one row. Rows with a null in a key are left out. Equal versions with
    different values give the larger value.
    """
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    best = [F.max(F.when(F.col(v).isNotNull(), F.struct(F.col(version), F.col(v)))).getField(v).alias(v) for v in values]
    return known.groupBy(*keys).agg(*best)


def rolling_totals(
    daily: DataFrame,
    entity: Sequence[str],
    day: str,
    values: Sequence[str],
    periods: Sequence[int] = (7, 30),
    bucket_days: int | None = None,
) -> DataFrame:
    """Totals and averages of each trailing period for every entity and calendar day.

    daily: at most one row per entity and day. The calendar runs from the table's first
    day to its last, so days without activity have rows too. Per value and period n:
    `{value}_sum_{n}d` (0 without activity) and `{value}_avg_{n}d` (the total over n
    days, also where the calendar is shorter), and `active_days_{n}d`.

    Method: each entity-day is range-joined with the daily totals in (day - n, day]. An
    equality on a coarse date bucket restricts the candidates: with buckets as long as
    the longest period an entity-day looks into two. The join is an ordinary hash or
    sort-merge join on entity and bucket; an entity has at most a bucket's days in it,
    so no key is hot. Sums are combined before the last shuffle.

    Null values count as 0; rows with a null entity or day are left out. An empty
    table gives no rows.
    """
    longest = max(periods)
    width = bucket_days or longest
    num = F.date_diff(F.col(day), F.lit("1970-01-01").cast("date"))
    known = daily.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*entity, day]))
    facts = known.select(*entity, num.alias("_d"), F.floor(num / width).cast("int").alias("_b"), *(F.coalesce(v, F.lit(0)).cast("bigint").alias(v) for v in values))
    span = known.agg(F.min(num).alias("_lo"), F.max(num).alias("_hi"))
    calendar = (
        known.select(*entity)
        .distinct()
        .crossJoin(F.broadcast(span))  # one row
        .withColumn("_day", F.explode(F.sequence("_lo", "_hi")))
        .withColumn("_b", F.explode(F.sequence(F.floor((F.col("_day") - (longest - 1)) / width).cast("int"), F.floor(F.col("_day") / width).cast("int"))))
        .select(*entity, "_day", "_b")
    )
    c, f = calendar.alias("c"), facts.alias("f")
    on = [F.col(f"c.{k}") == F.col(f"f.{k}") for k in entity] + [
        F.col("c._b") == F.col("f._b"),
        F.col("f._d") <= F.col("c._day"),
        F.col("f._d") > F.col("c._day") - longest,
    ]
    joined = c.join(f, on, "left")
    back = F.col("c._day") - F.col("f._d")
    totals = []
    for n in periods:
        totals.append(F.count_if(back < n).alias(f"active_days_{n}d"))
        totals += [F.coalesce(F.sum(F.when(back < n, F.col(f"f.{v}"))), F.lit(0)).alias(f"{v}_sum_{n}d") for v in values]
    out = joined.groupBy(*(F.col(f"c.{k}").alias(k) for k in entity), F.col("c._day").alias("_day")).agg(*totals)
    cols = [F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day")).alias(day)]
    for n in periods:
        cols.append(F.col(f"active_days_{n}d"))
        for v in values:
            cols += [F.col(f"{v}_sum_{n}d"), (F.col(f"{v}_sum_{n}d").cast("double") / n).alias(f"{v}_avg_{n}d")]
    return out.select(*entity, *cols)
