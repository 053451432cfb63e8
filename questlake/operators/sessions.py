"""Sessions: a user's events split where more than a gap passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from questlake.functions.scalars import micros


def sessions(events: DataFrame, user: str = "player_id", time: str = "event_time", gap_seconds: int = 1800, event_id: str | None = None) -> DataFrame:
    """One row per session: user, session_no, start_us, end_us, row_cnt and, with ``event_id``, event_cnt.

    A session ends where more than ``gap_seconds`` pass until the user's next event; a
    pause of exactly the gap goes on. Method: a lag over each user's times flags the
    gaps, a running sum of the flags numbers the sessions, then they are aggregated.

    No window runs over raw events. Times are first grouped into bins as wide as the
    gap; two times in one bin are closer than the gap, so a bin never holds a session
    border, and first, last and count of a bin are all the window needs. The bins
    aggregate before the shuffle, and a user has at most one row a bin in the window,
    however many events: one holding a third of all rows is no hotter than others.

    Rows with a null user or time are left out. Equal times are one moment, repeated
    rows count in row_cnt. event_cnt counts the different identifiers of a session, and
    each row without one; an identifier in two sessions counts in both. An empty table
    gives no rows; other columns are not read.
    """
    gap = gap_seconds * 1_000_000
    rows = events.where(F.col(user).isNotNull() & F.col(time).isNotNull()).select(
        F.col(user).alias("_u"), micros(F.col(time)).alias("_t"), *([F.col(event_id).alias("_id")] if event_id else [])
    )
    rows = rows.withColumn("_bin", F.floor(F.col("_t") / F.lit(gap)).cast("bigint")) if gap > 0 else rows.withColumn("_bin", F.col("_t"))
    without = [F.count_if(F.col("_id").isNull()).alias("_e")] if event_id else []
    bins = rows.groupBy("_u", "_bin").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count("*").alias("_n"), *without)
    w = W.partitionBy("_u").orderBy("_bin")
    if event_id:
        bins = bins.join(_identifiers(rows), ["_u", "_bin"], "left")
    starts = F.when(F.col("_lo") - F.lag("_hi").over(w) <= gap, 0).otherwise(1)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    numbered = bins.withColumn("_new", starts).withColumn("_no", F.sum("_new").over(upto))
    out = [F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"), F.sum("_n").alias("row_cnt")]
    if event_id:
        # an identifier counts in a bin if it was last seen before the session's first bin, or never
        numbered = numbered.withColumn("_from", F.max(F.when(F.col("_new") == 1, F.col("_bin"))).over(upto))
        earlier = F.aggregate(F.filter("_seen", lambda x: x["_prev"] < F.col("_from")), F.lit(0).cast("bigint"), lambda n, x: n + x["_c"])
        out.append(F.sum(F.col("_e") + F.coalesce("_fresh", F.lit(0)) + F.coalesce(earlier, F.lit(0))).alias("event_cnt"))
    return numbered.groupBy(F.col("_u").alias(user), F.col("_no").alias("session_no")).agg(*out)


def _identifiers(rows: DataFrame) -> DataFrame:
    """Per user and bin: the number of identifiers not seen before, and how many were last seen in which earlier bin.

    An identifier's bins are gathered into one short row (combined before the shuffle),
    so its repetitions need no window; the earlier bins of a bin are counted, so a row
    is as long as the calendar at most.
    """
    times = rows.where("_id IS NOT NULL").groupBy("_u", "_id").agg(F.array_sort(F.collect_set("_bin")).alias("_b"))
    each = times.select("_u", F.inline(F.transform("_b", lambda b, i: F.struct(b.alias("_bin"), F.when(i > 0, F.get("_b", i - 1)).alias("_prev")))))
    counted = each.groupBy("_u", "_bin", "_prev").agg(F.count("*").alias("_c"))
    pair = F.when(F.col("_prev").isNotNull(), F.struct("_prev", "_c"))
    return counted.groupBy("_u", "_bin").agg(F.sum(F.when(F.col("_prev").isNull(), F.col("_c"))).alias("_fresh"), F.collect_list(pair).alias("_seen"))
