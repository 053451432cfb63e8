"""Queries that must take all rows of their tables, beyond what their SQL compares."""

import __spark_entry__ as entry
from compare import connect, differences

FOLDER = "/root/testdata/sf0.01"


def test_streamed_recharges_take_the_amount_from_the_payload(spark):
    sql = """SELECT 'recharge_total' AS agg_key, COUNT(*) AS recharge_cnt, CAST(SUM(CAST(amount AS DECIMAL(18,2)) / 100) AS DECIMAL(18,2)) AS recharge_sum, COUNT(DISTINCT player_id) AS players FROM (
      SELECT event_id, ANY_VALUE(amount) AS amount, ANY_VALUE(player_id) AS player_id FROM (
        SELECT *, COALESCE(amount_fen, TRY_CAST(json_extract_string(payload, '$.amount_fen') AS BIGINT)) AS amount FROM ods_player_events)
      WHERE event_id IS NOT NULL AND event_type = 'recharge' AND player_id IS NOT NULL AND amount IS NOT NULL GROUP BY event_id)"""
    assert differences(entry.queries()["stream_recharge_agg"](spark, FOLDER), connect(FOLDER), sql) == ""


def test_json_scan_keeps_rows_without_an_id(spark):
    sql = """SELECT event_id, event_type, event_time, player_id, role_id, server_id, session_id, TRY_CAST(json_extract_string(payload, '$.dungeon_id') AS INTEGER) AS dungeon_id,
      TRY_CAST(json_extract_string(payload, '$.amount_fen') AS BIGINT) AS amount_fen, TRY_CAST(json_extract_string(payload, '$.online_sec') AS INTEGER) AS online_sec FROM ods_player_events"""
    assert differences(entry.queries()["ods_json_scan"](spark, FOLDER), connect(FOLDER), sql) == ""


def test_generator_is_registered_at_the_size_of_the_reference(spark):
    rows = entry.queries()["gen_events"](spark, FOLDER)
    assert rows.count() == 200_000 and rows.select("event_id").distinct().count() == 200_000
    assert 9_000 < rows.select("player_id").distinct().count() <= 10_000
