"""Streamed metrics over the keyed player-day and dungeon-day tables equal the batch metrics, whatever comes late or again."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from questlake.operators import layers, metrics, reports
from questlake.sources.ods import table
from questlake.streaming import jobs

RAW = "event_id string, event_type string, event_time timestamp, player_id bigint, role_id bigint, server_id int, session_id string, payload string"


@pytest.fixture
def frame(spark):
    def make(*rows):
        full = [(i, kind, dt.datetime(2024, 1, day, 10, tzinfo=dt.timezone.utc), player, 0, 1, "s", json.dumps(payload)) for i, kind, day, player, payload in rows]
        return spark.createDataFrame(full, RAW)

    return make


def values(live, name, *cols):
    return sorted(tuple(r[c] for c in ("dt", *cols)) for r in live.tables[name].read().collect())


def test_metrics_are_corrected_and_retracted(spark, tmp_path, frame):
    live = jobs.LiveMetrics(spark, f"file://{tmp_path}/live")
    first, second = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    live(frame(("a", "recharge", 2, 1, {"amount_fen": 500}), ("b", "logout", 2, 2, {"online_sec": 60}), ("c", "enter_dungeon", 2, 2, {"dungeon_id": 7})), 0)
    assert values(live, "ads_arpu_di", "dau", "revenue_cny", "arpu_cny") == [(second, 2, 5.0, 2.5)]
    assert values(live, "ads_online_duration_di", "total_online_sec", "avg_online_sec") == [(second, 60, 30.0)]
    assert values(live, "ads_dungeon_clear_rate_di", "dungeon_id", "clear_rate") == [(second, 7, 0.0)]
    again = frame(("a", "recharge", 1, 1, {"amount_fen": 300}), ("d", "clear_dungeon", 2, 2, {"dungeon_id": 7}), ("b", "logout", 3, 2, {"online_sec": 99}))
    for batch in (1, 1, 2):  # a replay of the batch and of its rows changes nothing
        live(again, batch)
        assert values(live, "ads_arpu_di", "dau", "revenue_cny") == [(first, 1, 3.0), (second, 1, 0.0)]
        assert values(live, "ads_pay_rate_di", "pay_users") == [(first, 1), (second, 0)]
        assert values(live, "dws_player_behavior_di", "player_id") == [(first, 1), (second, 2)]
        assert values(live, "ads_dungeon_clear_rate_di", "clear_rate") == [(second, 1.0)]
        assert [(r.recharge_cnt, r.recharge_sum) for r in live.recharges.read().collect()] == [(1, Decimal("3.00"))]


def test_a_batch_broken_off_is_redone_with_its_retractions(spark, tmp_path, frame):
    live = jobs.LiveMetrics(spark, f"file://{tmp_path}/live")
    live(frame(("a", "recharge", 2, 1, {"amount_fen": 500})), 0)
    merge, earlier = live.tables["ads_arpu_di"].merge, frame(("a", "recharge", 1, 1, {"amount_fen": 500}))
    live.tables["ads_arpu_di"].merge = lambda *args: (_ for _ in ()).throw(OSError())
    with pytest.raises(OSError):
        live(earlier, 1)
    live.tables["ads_arpu_di"].merge = merge
    live(earlier, 1)
    for name in ("ads_dau_di", "ads_arpu_di"):
        assert values(live, name, "dau") == [(dt.date(2024, 1, 1), 1)]


def test_streamed_tables_equal_batch(spark, tmp_path):
    raw = table(spark, "/root/testdata/sf0.001", "ods_player_events").withColumn("event_time", F.col("event_time").cast("timestamp"))
    raw.repartition(3, "session_id").write.parquet(f"{tmp_path}/in")
    live = jobs.LiveMetrics(spark, f"file://{tmp_path}/live")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(live).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    dwd = layers.clean_raw(raw)
    days, dungeons = (f(dwd).where("server_id IS NOT NULL") for f in (layers.player_day, layers.dungeon_day))
    want = {k: v for k, v in metrics.all_metrics(days, dungeons).items() if k in live.tables} | {"dws_player_behavior_di": days, "dws_dungeon_behavior_di": dungeons}
    assert set(want) == set(live.tables)
    for name, df in want.items():
        rows = lambda x, names=df.columns: sorted(map(repr, (tuple(r[c] for c in names) for r in x.collect())))
        assert rows(live.tables[name].read()) == rows(df), name
    assert live.recharges.read().collect() == reports.recharge_total(dwd).collect()
