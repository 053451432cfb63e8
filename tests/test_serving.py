"""Keyed serving tables, change records and the read-only contract."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from questlake.operators import guard
from questlake.operators.keyed_table import KeyedTable, ServingSink, decode_changes, read_jdbc_on_driver, with_backoff, write_jdbc

ROOT = Path(__file__).resolve().parent.parent

PAY = "dt date, server_id int, dau bigint, pay_users bigint, pay_rate double, metric_id string"


def record(dt, server, seq, value="x", **change):
    key = json.dumps({"dt": dt, "server_id": server})
    if value == "x":
        value = json.dumps({"dt": dt, "server_id": server, "dau": 4, "pay_users": 1, "pay_rate": 0.25, "metric_id": "ads_pay_rate_di"} | change)
    return ("pay", key, value, seq)


@pytest.fixture
def log(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "topic string, key string, value string, seq bigint")


def state(table):
    return sorted((str(r.dt), r.server_id, r.dau) for r in table.read().collect())


def test_upsert_tombstone_and_replay(spark, tmp_path, log):
    table = KeyedTable(spark, f"file://{tmp_path}/t", PAY, ["dt", "server_id"])
    sink = ServingSink(table, PAY, f"file://{tmp_path}/dead")
    sink(log(record("2024-01-01", 1, 1), record("2024-01-01", 2, 2), record("2024-01-02T00:00:00", 1, 3), record("2024-01-01", 1, 4, dau=6)), 0)
    assert state(table) == [("2024-01-01", 1, 6), ("2024-01-01", 2, 4), ("2024-01-02", 1, 4)]
    again = log(record("2024-01-01", 1, 5, None), record("2024-01-02", 1, 6, None), record("2024-01-01", 2, 7, dau=9))
    sink(again, 1)
    assert state(table) == [("2024-01-01", 2, 9)]
    sink(again, 1)
    sink(log(record("2024-01-01", 1, 5, None)), 2)
    assert state(table) == [("2024-01-01", 2, 9)]


def test_dead_letters(spark, tmp_path, log):
    table = KeyedTable(spark, f"file://{tmp_path}/t", PAY, ["dt", "server_id"])
    sink = ServingSink(table, PAY, f"file://{tmp_path}/dead")
    bad = [("pay", "{", "{}", 1), record("2024-01-01", 1, 2, "[1]"), record("2024-01-01", 1, 3, pay_rate=None), record("soon", 1, 4), ("pay", None, None, 5), record("2024-01-01", 1, 6, "no json")]
    sink(log(*bad, record("2024-01-03", 3, 7)), 0)
    assert state(table) == [("2024-01-03", 3, 4)]
    dead = spark.read.json(f"file://{tmp_path}/dead/batch=0")
    assert dead.count() == 6 == sink.counters["dead_letters"] and dead.where("error IS NULL").count() == 0


def test_transient_errors_are_retried_and_the_state_waits(spark, tmp_path, log):
    table = KeyedTable(spark, f"file://{tmp_path}/t", PAY, ["dt", "server_id"])
    sink = ServingSink(table, PAY, sleep=(waits := []).append)
    publish, tries = table.manifest.publish, []

    def flaky(*args):
        tries.append(state(table))
        if len(tries) < 3:
            raise OSError("no answer")
        publish(*args)

    table.manifest.publish = flaky
    sink(log(record("2024-01-01", 1, 1)), 0)
    assert tries == [[], [], []] and waits == [1.0, 2.0] and state(table) == [("2024-01-01", 1, 4)]


def test_backoff_is_capped_and_gives_up():
    waits = []
    with pytest.raises(OSError):
        with_backoff(lambda: (_ for _ in ()).throw(OSError()), attempts=8, sleep=waits.append)
    assert waits == [1, 2, 4, 8, 16, 30, 30]


def test_null_keys_are_refused(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "dt date, n int", ["dt"])
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([(None, 1, "upsert")], "dt date, n int, op string"), 0)
    assert table.read().count() == 0


def test_decode_takes_key_columns_from_the_key(spark, log):
    good, bad = decode_changes(log(record("2024-01-01", 1, 1, '{"dau": 1, "pay_users": 0, "pay_rate": 0.0, "metric_id": "m"}')), PAY, ["dt", "server_id"])
    assert good.count() == 1 and bad.count() == 0


ALLOWED = [
    "SELECT dt, server_id, dau, metric_id FROM ads.ads_dau_di WHERE metric_id = 'ads_dau_di' ORDER BY dt, server_id",
    "SELECT dt, server_id, dau, pay_users, pay_rate, metric_id FROM ads_pay_rate_di p WHERE p.dau > 0",
    "WITH x AS (SELECT dt, SUM(dau) n FROM ads.ads_dau_di GROUP BY dt) SELECT x.n, (SELECT MAX(arpu_cny) FROM ads_arpu_di) FROM x JOIN ads.ads_churn_di c ON c.dt = x.dt",
    "SELECT ads.ads_dau_di.dau FROM ads.ads_dau_di",
    "SELECT dau FROM /* a comment */ ads.ads_dau_di -- ads.secret",
    "SELECT 'FROM ads.secret' AS t, `ads`.`ads_dau_di`.dau FROM `ads`.`ads_dau_di` WHERE metric_id <> 'ads.ads_dau_di'",
    "SELECT upper(metric_id), row_number() OVER (PARTITION BY server_id ORDER BY dt) FROM ads_dau_di",
]
BLOCKED = [
    "SELECT not_a_real_col FROM ads.ads_dau_di",
    "SELECT * FROM ads.ads_not_on_allowlist",
    "SELECT dau FROM hive.ads_dau_di",
    "DELETE FROM ads.ads_dau_di",
    "INSERT INTO ads.ads_dau_di SELECT * FROM ads.ads_dau_di",
    "UPDATE ads.ads_dau_di SET dau = 1",
    "DROP TABLE ads.ads_dau_di",
    "CREATE TABLE x AS SELECT 1",
    "SELECT dau FROM ads_dau_di WHERE dt IN (SELECT dt FROM secret.t)",
    "SELECT window_complete FROM ads.ads_retention_nd",
    "SELECT FROM WHERE",
    "SELECT 1; DROP TABLE ads.ads_dau_di",
    "SELECT reflect('java.lang.System', 'exit', 0) FROM ads.ads_dau_di",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME') FROM ads.ads_dau_di",
    "SELECT dau FROM ads.ads_dau_di WHERE dau IN (SELECT length(reflect('java.lang.System', 'lineSeparator')) FROM ads_dau_di)",
    "SELECT dau FROM ads.ads_dau_di TABLESAMPLE (5 ROWS)",
    "SELECT * FROM range(5)",
    "SELECT explode(array(1)) FROM ads.ads_dau_di",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_reads_pass(spark, sql):
    assert guard.check(spark, sql) == guard.Verdict(True, "ok")


@pytest.mark.parametrize("sql", BLOCKED)
def test_others_are_blocked(spark, sql):
    verdict = guard.check(spark, sql)
    assert not verdict.allowed and verdict.reason.strip() and not verdict.reason.startswith(" ")


def test_dimensions_of_a_metric(spark):
    df = spark.createDataFrame([("2024-01-01", 1, 5), ("2024-01-02", 2, 6)], "dt string, server_id int, dau int")
    assert [r.dau for r in guard.cut(df, "ads_dau_di", ["dt"], server_id=2).collect()] == [6]
    for name in ("player_id", "dungeon_id"):
        with pytest.raises(guard.UnknownDimension):
            guard.cut(df, "ads_dau_di", [name])


def test_a_poisoned_batch_is_skipped_and_recorded(spark, tmp_path, log):
    table = KeyedTable(spark, f"file://{tmp_path}/t", PAY, ["dt", "server_id"])
    waits = []
    sink = ServingSink(table, PAY, f"file://{tmp_path}/dead", sleep=waits.append)
    merge, table.merge = table.merge, lambda *a, **k: (_ for _ in ()).throw(TypeError("no such cast"))
    sink(log(record("2024-01-01", 1, 1)), 0)
    table.merge = merge
    sink(log(record("2024-01-02", 1, 2)), 1)
    assert waits == [] and sink.counters["poisoned"] == 1 and state(table) == [("2024-01-02", 1, 4)]
    assert [r.error for r in spark.read.json(f"file://{tmp_path}/dead/poison=0").collect()] == ["TypeError: no such cast"]


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.mark.parametrize("on_driver", [False, True])
def test_jdbc_both_ways(spark, tmp_path, on_driver):
    rows = spark.range(0, 107, 1, 3).selectExpr("date_add(date'2024-02-28', cast(id % 3 as int)) AS day", "cast(id AS int) AS n", "if(id % 7 = 0, NULL, concat('x', id)) AS s", "timestamp_ntz'2024-03-01 02:30:01.123456' AS at", "id / 3 AS x")
    url = f"jdbc:derby:memory:both{on_driver};create=true"
    write = lambda df, mode: write_jdbc(df, url, "t", DERBY, flush_rows=10, mode=mode, on_driver=on_driver, attempts=1)
    read = lambda k: read_jdbc_on_driver(spark, url, "t", f"file://{tmp_path}/{k}", DERBY, rows=25).withColumn("at", F.col("at").cast("timestamp_ntz"))
    write(rows, "append")
    assert sorted(read(1).collect(), key=lambda r: r.n) == rows.collect()
    write(rows.where("n < 4"), "append")
    assert read(2).count() == 111
    write(rows.where("n < 0"), "overwrite")
    assert read(3).count() == 0


def test_jdbc_on_driver_leaves_nothing_of_a_failed_write(spark, tmp_path):
    url = "jdbc:derby:memory:failed;create=true"
    rows = spark.range(0, 40, 1, 2).selectExpr("id", "if(id = 39, raise_error('lost'), 1L) AS v")
    with pytest.raises(Exception, match="lost"):
        write_jdbc(rows, url, "t", DERBY, flush_rows=5, on_driver=True, attempts=2, sleep=lambda s: None)
    assert read_jdbc_on_driver(spark, url, "t", f"file://{tmp_path}/t", DERBY).count() == 0


CLUSTER = """
import sys
from pyspark.sql import SparkSession
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{sys.argv[1]}", "spark.sql.shuffle.partitions": "2"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
import __spark_entry__ as e
for name in ("jdbc_dau", "ads_dau_di"):
    rows = e.queries()[name](spark, "/root/testdata/sf0.001").where("server_id IS NOT NULL").select("dt", "server_id", "dau", "metric_id").collect()
    print("ROWS", name, sorted(map(str, rows)), flush=True)
"""


def test_jdbc_query_on_a_cluster(tmp_path):
    run = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], capture_output=True, text=True, timeout=600, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(ROOT)})
    found = dict(line.split(" ", 2)[1:] for line in run.stdout.splitlines() if line.startswith("ROWS "))
    assert "jdbc_dau" in found, run.stderr[-2000:]
    assert found["jdbc_dau"] == found["ads_dau_di"] != "[]"
