"""Streaming fixtures: disorder and late rows, idempotent totals over restarts, correctable gauges."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questlake.operators.keyed_table import KeyedTable
from questlake.schema import RECHARGE_EVENT, STREAM_EVENT
from questlake.sources.ods import stream_ndjson
from questlake.sources.topic import FileTopic
from questlake.streaming import jobs, observe

BASE = dt.datetime(2026, 9, 7, 10, 0, 0)


def ev(i, kind, sec, player, tag="t", base=BASE, **extra):
    return {"event_id": i, "event_type": kind, "event_time": (base + dt.timedelta(seconds=sec)).strftime("%Y-%m-%d %H:%M:%S"), "player_id": player, "server_id": 1, "tag": tag} | extra


DISORDER = [
    ev("g3-in-01", "login", 5, 1001), ev("g3-in-02", "login", 15, 1002), ev("g3-in-03", "enter_dungeon", 25, 1003), ev("g3-ooo-hi", "login", 30, 1004),
    ev("g3-ooo-lo", "login", 27, 1005), ev("g3-dup-01", "recharge", 35, 1006), ev("g3-dup-01", "recharge", 35, 1006), ev("g3-in-04", "logout", 50, 1007),
    ev("g3-w2-01", "login", 70, 2001), ev("g3-late-01", "login", 40, 9001), ev("g3-w2-02", "login", 80, 2002), ev("g3-w2-close", "login", 130, 3001),
]


def test_minute_windows_drop_late_rows(spark, tmp_path):
    topic = FileTopic(str(tmp_path / "in"))
    q = jobs.minute_windows(stream_ndjson(spark, str(tmp_path / "in"), STREAM_EVENT)).writeStream.format("memory").queryName("minutes").option("checkpointLocation", str(tmp_path / "cp")).start()
    for phase in (DISORDER[:9], DISORDER[9:10], DISORDER[10:]):
        topic.produce(phase)
        q.processAllAvailable()
    q.processAllAvailable()
    progress = [p for p in observe._progress(q)]
    q.stop()
    rows = [(r.window_start.minute, r.event_cnt, r.player_cnt) for r in spark.table("minutes").orderBy("window_start").collect()]
    assert rows == [(0, 7, 7), (1, 2, 2)]
    assert observe.batch_durations(progress)["n"] >= 3
    assert observe.source_lag([])["missing"]


def recharge(i, amount, player, hms):
    return ev(i, "recharge", 0, player) | {"event_time": f"2026-09-07 {hms}", "amount": amount}


def test_recharge_total_over_restarts(spark, tmp_path):
    topic = FileTopic(str(tmp_path / "in"))
    table = KeyedTable(spark, f"file://{tmp_path}/t", "agg_key string, recharge_cnt bigint, recharge_sum decimal(18,2), players bigint", ["agg_key"], part="agg_key")

    def run():
        events = stream_ndjson(spark, str(tmp_path / "in"), RECHARGE_EVENT)
        jobs.to_keyed(jobs.recharge_gauge(events), table, str(tmp_path / "cp")).awaitTermination()
        r = table.read().collect()[0]
        return r.recharge_cnt, r.recharge_sum, r.players

    first = [recharge(f"r-0{k}", a, 1000 + k, f"12:00:0{k}") for k, a in enumerate((6, 12, 30, 68, 128), 1)]
    topic.produce([*first, first[0] | {"event_time": "2026-09-07 12:00:06"}, first[2] | {"event_time": "2026-09-07 12:00:07"}])
    assert run() == (5, Decimal("244.00"), 5)
    topic.produce([first[0], first[2], first[1] | {"event_time": "2026-09-07 12:01:00"}])
    assert run() == (5, Decimal("244.00"), 5)
    topic.produce([recharge("r-06", 98, 1006, "12:02:00")])
    assert run() == (6, Decimal("342.00"), 6)


@pytest.mark.parametrize("exact", [False, True])
def test_daily_gauge_is_corrected(spark, tmp_path, exact):
    base = dt.datetime(2026, 9, 7, 10, 0, 0)
    topic = FileTopic(str(tmp_path / "in"))
    b1 = [ev(f"c{k}", "login", k, 8000 + k, base=base) for k in range(1, 5)] + [ev("c5", "recharge", 5, 8005, base=base)]
    b1 += [b1[0], b1[4], ev("c6", "login", -2, 8006, base=base)]
    exact_gauge = jobs.ExactGauge(spark, f"file://{tmp_path}/exact")
    table = exact_gauge.gauge if exact else KeyedTable(spark, f"file://{tmp_path}/t", jobs.GAUGE, ["dt", "server_id"])

    def run():
        events = stream_ndjson(spark, str(tmp_path / "in"), STREAM_EVENT)
        if exact:
            events.writeStream.foreachBatch(exact_gauge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        else:
            jobs.to_keyed(jobs.daily_gauge(events), table, str(tmp_path / "cp")).awaitTermination()
        return [(r.dau, r.pay_users, r.pay_rate) for r in table.read().orderBy("dt").collect()]

    topic.produce(b1)
    assert run() == [(6, 1, pytest.approx(1 / 6))]
    topic.produce([ev("c7", "login", 7, 8007, base=base), ev("c8", "recharge", 8, 8008, base=base)])
    assert run() == [(8, 2, 0.25)]
    topic.produce(b1)
    assert run() == [(8, 2, 0.25)]
    topic.produce([ev("c9", "login", 9, 8009, base=base), ev("c10", "login", 10, 8010, base=base)])
    assert run() == [(10, 2, 0.2)]
    if exact:  # a replay with an earlier time on another day takes the event along
        topic.produce([ev("c10", "login", -86_400, 8010, base=base)])
        assert run() == [(1, 0, 0.0), (9, 2, pytest.approx(2 / 9))]


def test_day_windows_close_once(spark, tmp_path):
    schema = "event_id string, event_type string, event_time timestamp, player_id bigint, server_id int, dungeon_id int, amount_fen bigint, online_sec int"
    topic = FileTopic(str(tmp_path / "in"))
    rows = [ev("a", "enter_dungeon", 0, 1) | {"dungeon_id": 7}, ev("b", "recharge", 1, 1) | {"amount_fen": 5}, ev("c", "logout", 2, 1) | {"online_sec": 9}, ev("d", "death", 86_400 * 2, 2) | {"dungeon_id": 8}]
    topic.produce(rows)
    events = stream_ndjson(spark, str(tmp_path / "in"), T._parse_datatype_string(schema))
    for name, job in (("players", jobs.player_day_windows), ("dungeons", jobs.dungeon_day_windows)):
        q = job(events).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    r = spark.table("players").collect()
    assert [(x.event_cnt, x.enter_dungeon_cnt, x.recharge_fen, x.online_sec_sum) for x in r] == [(3, 1, 5, 9)]
    assert [(x.dungeon_id, x.enter_cnt, x.clear_cnt) for x in spark.table("dungeons").collect()] == [(7, 1, 0)]


def test_passthrough_clean_stream_and_supervisor(spark, tmp_path):
    topic = FileTopic(str(tmp_path / "in"))
    stamp = {"produce_ts": "2026-09-07 10:00:09.250"}
    whole = [row | stamp for row in DISORDER]
    topic.produce([*whole, ev(None, "login", 1, 1) | stamp, ev("x", "nonsense", 1, 1) | stamp, ev("no player", "login", 1, None) | stamp, ev("never published", "login", 1, 1)])
    events = stream_ndjson(spark, str(tmp_path / "in"), T.StructType([*STREAM_EVENT, T.StructField("produce_ts", T.TimestampType())]))
    tries = []

    def start():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("worker lost")
        return jobs.passthrough(events).writeStream.format("memory").queryName("through").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()

    assert jobs.supervise(start, sleep=lambda s: None) == 2
    through = spark.table("through")
    assert through.count() == 13 and through.where(F.col("sink_ts").isNull()).count() == 0
    assert {r.event_id for r in through.collect()} == {r["event_id"] for r in whole} | {"x"}
    for horizon, name in ((False, "life"), (True, "bounded")):
        jobs.clean_stream(events, horizon=horizon).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).select("event_id").distinct().count() == spark.table(name).count() == 12


@pytest.mark.parametrize("broken", ["gauge", "events"])
def test_exact_gauge_keeps_retractions_over_a_crash(spark, tmp_path, broken):
    """Killed at either publish, the batch that moves an event to another day still empties its former day."""
    rows = lambda *xs: spark.createDataFrame([(i, "login", dt.datetime(2024, 1, day, 10, tzinfo=dt.timezone.utc), p, 1) for i, day, p in xs], jobs.ExactGauge.COLUMNS)
    gauge = jobs.ExactGauge(spark, f"file://{tmp_path}/g")
    gauge(rows(("a", 2, 1), ("b", 2, 2)), 0)
    manifest = getattr(gauge, broken).manifest
    publish, manifest.publish = manifest.publish, lambda *_: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError):
        gauge(rows(("a", 1, 1)), 1)
    manifest.publish = publish
    again = jobs.ExactGauge(spark, f"file://{tmp_path}/g")  # a new process
    for _ in range(2):
        again(rows(("a", 1, 1)), 1)
        assert sorted((r.dt.day, r.dau) for r in again.gauge.read().collect()) == [(1, 1), (2, 1)]


def test_late_corrector_as_a_stream_sink(spark, tmp_path):
    from questlake.operators.late_events import LateCorrector

    at = lambda sec: (BASE + dt.timedelta(seconds=sec)).strftime("%Y-%m-%d %H:%M:%S")
    row = lambda i, sec, sink: {"event_id": i, "event_time": at(sec), "player_id": 1, "server_id": 1, "produce_ts": at(sec), "sink_ts": at(sink)}
    topic, corrector = FileTopic(str(tmp_path / "in")), LateCorrector(spark, f"file://{tmp_path}/late")
    schema = T._parse_datatype_string("event_id string, event_time timestamp_ntz, player_id bigint, server_id int, produce_ts timestamp_ntz, sink_ts timestamp_ntz")
    for rows in ([row("a", 1, 2), row("b", 61, 62)], [row("c", 5, 300), row("a", 1, 301), row("d", 2, 5000)]):
        topic.produce(rows)
        events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        events.writeStream.foreachBatch(lambda df, i: corrector.apply(df, i)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.window_start.minute, r.event_cnt, r.on_time_event_cnt, r.late_event_cnt) for r in corrector.figures().collect())
    assert got == [(0, 2, 1, 1), (1, 1, 1, 0)]


def test_file_topic(tmp_path):
    topic = FileTopic(str(tmp_path / "t"), segment_rows=2)
    assert topic.produce({"n": i} for i in range(5)) == 5
    assert len(topic.segments()) == 3 and [r["n"] for r in topic.consume()] == list(range(5))
    topic.clear()
    assert list(topic.consume()) == []


def test_measures():
    assert observe.nearest_rank([1, 2, 3, 4], 0.5) == 2 and observe.nearest_rank([], 0.5) is None
    p = [{"durationMs": {"triggerExecution": x}, "numInputRows": 1, "processedRowsPerSecond": 10.0} for x in (10, 20, 30, 40)]
    assert observe.batch_durations(p) == {"n": 4, "avg": 25.0, "p50": 30, "p95": 40, "min": 10, "max": 40}
    assert observe.throughput(p) == {"avg": 10.0, "max": 10.0} and observe.pressure(p, 100)["level"] == "ok"
