"""The eleven-row fixture with exact values, from JSON lines to all metrics."""

import datetime as dt
import json

import pytest

from questlake.operators import layers, metrics, reports
from questlake.sources.ods import parse_envelope, read_ndjson


def event(event_id, kind, when, player, **payload):
    return {"event_id": event_id, "event_type": kind, "event_time": f"2024-01-{when}:00.000Z", "player_id": player, "role_id": player * 10, "server_id": 1, "session_id": f"s{player}", "payload": payload}


ROWS = [
    event("e101-login", "login", "01T10:00", 101),
    event("e101-login-dup", "login", "01T10:05", 101),
    event("e102-login", "login", "01T11:00", 102),
    event("e103-login", "login", "01T12:00", 103),
    event("e103-recharge", "recharge", "01T12:30", 103, amount_fen=10000),
    event("e103-recharge", "recharge", "01T12:31", 103, amount_fen=10000),
    event("e101-d1", "login", "02T10:00", 101),
    event("e102-d1", "login", "02T11:00", 102),
    event("e101-d3", "login", "04T10:00", 101),
    event("e101-d7", "login", "08T10:00", 101),
    event("e101-logout-d7", "logout", "08T11:00", 101, online_sec=3600),
]


@pytest.fixture(scope="module")
def ods(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "events.jsonl"
    path.write_text("\n".join(map(json.dumps, ROWS)) + "\n\n")
    return read_ndjson(spark, str(path))


@pytest.fixture(scope="module")
def days(ods):
    return layers.player_day(layers.clean(ods)).cache()


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def day(n):
    return dt.date(2024, 1, n)


def test_clean_keeps_one_row_per_id_and_the_earliest(ods):
    rows = by(layers.clean(ods), "event_id")
    assert len(rows) == 10
    assert rows[("e103-recharge",)].event_time.minute == 30
    assert rows[("e103-recharge",)].amount_fen == 10000


def test_dau_and_pay(days):
    assert {k[0]: r.dau for k, r in by(metrics.dau(days), "dt").items()} == {day(1): 3, day(2): 2, day(4): 1, day(8): 1}
    pay = by(metrics.pay_rate(days), "dt")[(day(1),)]
    assert (pay.dau, pay.pay_users, pay.pay_rate) == (3, 1, pytest.approx(1 / 3))
    money = by(metrics.arpu(days), "dt")[(day(1),)]
    assert (money.revenue_cny, money.arpu_cny) == (100.0, pytest.approx(100 / 3))


def test_retention_only_for_complete_windows(days):
    rows = by(metrics.retention(days), "cohort_dt", "n_days")
    assert set(rows) == {(day(1), 1), (day(1), 3), (day(1), 7)}
    assert [(rows[(day(1), n)].cohort_size, rows[(day(1), n)].retained_cnt) for n in (1, 3, 7)] == [(3, 2), (3, 1), (3, 1)]
    assert all(r.window_complete for r in rows.values())


def test_online_and_churn(days):
    online = by(metrics.online_duration(days), "dt")[(day(8),)]
    assert (online.total_online_sec, online.players, online.avg_online_sec) == (3600, 1, 3600.0)
    churn = by(metrics.churn(days), "dt")
    assert {k[0]: (r.active_7d_users, r.churn_risk_users) for k, r in churn.items()} == {day(1): (3, 0), day(2): (3, 0), day(4): (3, 1), day(8): (2, 1)}


def test_clear_rate_is_null_without_an_entry(spark):
    rows = [("a", "death", 5), ("b", "enter_dungeon", 6), ("c", "clear_dungeon", 6), ("d", "enter_dungeon", 6)]
    lines = spark.createDataFrame([(json.dumps(event(i, k, "01T10:00", 1, dungeon_id=d)),) for i, k, d in rows], "value string")
    rate = by(metrics.dungeon_clear_rate(layers.dungeon_day(layers.clean(parse_envelope(lines)))), "dungeon_id")
    assert rate[(5,)].clear_rate is None and (rate[(5,)].enter_cnt, rate[(5,)].clear_cnt) == (0, 0)
    assert rate[(6,)].clear_rate == 0.5


def test_reports(days):
    dau, pay = metrics.dau(days), metrics.pay_rate(days)
    assert by(reports.dau_by_day(dau), "dt")[(day(1),)].dau_all == 3
    assert by(reports.serving_row(dau, pay), "dt")[(day(1),)].serving_row == "3|1"
    counts = {r.table_name: r.row_cnt for r in reports.row_counts(metrics.all_metrics(days, layers.dungeon_day(days.selectExpr("dt", "server_id", "1 dungeon_id", "'death' event_type")))).collect()}
    assert counts["ads_dau_di"] == 4 and counts["ads_retention_nd"] == 3


def test_unreadable_lines(spark):
    lines = spark.createDataFrame([('{"event_id": "x", "player_id": "no number", "event_type": "login", "event_time": "2024-01-01 00:00:00"}',), ("{broken",), ("  ",), ("[1]",)], "value string")
    kept = parse_envelope(lines).collect()
    assert [r.event_id for r in kept] == ["x"] and kept[0].player_id is None
    assert len(parse_envelope(lines, on_error="keep").collect()) == 3
    with pytest.raises(Exception):
        parse_envelope(lines, on_error="fail").collect()
