"""Queries of files, sinks, the serving tables and the read contract, and their SQL."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlake.operators import guard, metrics, reports
from questlake.operators.keyed_table import KeyedTable, ServingSink, read_jdbc_on_driver, write_jdbc
from questlake.plans import core, core_sql, pipeline
from questlake.schema import ALLOWED_DIMS, METRICS, PROMOTED
from questlake.sources import ods as sources
from questlake.workspace import new_folder

SERVED = "dt date, server_id int, dau bigint, metric_id string"


def json_lines(rows: DataFrame) -> DataFrame:
    """Envelopes as JSON text, times in ISO form, the payload as an object."""
    iso = F.concat(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    payload = F.when(F.col("payload").isNotNull(), F.parse_json("payload"))
    return rows.select(F.to_json(F.struct("event_id", "event_type", iso.alias("event_time"), "player_id", "role_id", "server_id", "session_id", payload.alias("payload"))).alias("value"))


def ndjson_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files of JSON lines, each line followed by a blank one and by its own broken first half: the whole ones come back."""
    folder = new_folder(spark, "lines")
    lines = json_lines(sources.table(spark, d, core.ODS).drop(*PROMOTED))
    each = F.explode(F.array("value", F.lit("  "), F.expr("substring(value, 1, length(value) div 2)")))
    lines.select(each.alias("value")).write.text(folder)
    return sources.read_ndjson(spark, folder).drop("payload").withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def _served(spark: SparkSession, d: str) -> tuple[KeyedTable, str]:
    """Published DAU as change records in two batches, then the first again.

    The second raises even figures by one and deletes odd ones. Keys are written with
    blanks and times; rows without a figure or name are dead letters.
    """
    folder = new_folder(spark, "serving")
    rows = sources.table(spark, d, "ads_dau_di")
    key = F.to_json(F.struct(F.concat(F.lit(" "), F.col("dt").cast("string"), F.lit("T00:00:00")).alias("dt"), F.concat(F.lit(" "), F.col("server_id").cast("string"), F.lit(" ")).alias("server_id")))
    value = lambda dau: F.to_json(F.struct("dt", "server_id", dau.alias("dau"), "metric_id"))
    record = lambda v, seq: rows.select(F.lit("dau").alias("topic"), key.alias("key"), v.alias("value"), F.lit(seq).cast("bigint").alias("seq"))
    first = record(value(F.col("dau")), 1)
    second = record(F.when(F.coalesce(F.col("dau") % 2, F.lit(0)) == 0, value(F.col("dau") + 1)), 2)
    target = KeyedTable(spark, f"{folder}/table", SERVED, ["dt", "server_id"])
    sink = ServingSink(target, SERVED, f"{folder}/dead")
    for batch, log in ((0, first), (1, second), (0, first)):
        sink(log, batch)
    return target, f"{folder}/dead"


def serving_table(spark: SparkSession, d: str) -> DataFrame:
    return _served(spark, d)[0].read()


def serving_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    dead = spark.read.schema("topic string, key string, value string, error string, batch int").json(_served(spark, d)[1])
    return dead.groupBy("batch", "error").agg(F.count("*").alias("records"))


def jdbc_dau(spark: SparkSession, d: str) -> DataFrame:
    """DAU written to a database and read back: one embedded in the driver, so that the same is done on any master."""
    name = f"jdbc:derby:memory:{uuid.uuid4().hex}"
    url, driver = f"{name};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        write_jdbc(metrics.dau(core.presence(spark, d)).where("server_id IS NOT NULL"), url, "ads_dau_di", driver, on_driver=True)
        back = read_jdbc_on_driver(spark, url, "ads_dau_di", new_folder(spark, "jdbc"), driver)
    finally:
        with contextlib.suppress(Py4JJavaError):  # a drop is told by an error too
            spark._jvm.java.sql.DriverManager.getConnection(f"{name};drop=true")
    return back.toDF(*(c.lower() for c in back.columns))


def pipeline_reload(spark: SparkSession, d: str) -> DataFrame:
    """The whole batch run over JSON lines, twice into one folder: every table is replaced."""
    folder = new_folder(spark, "reload")
    json_lines(sources.table(spark, d, core.ODS).drop(*PROMOTED)).write.text(f"{folder}/lines")
    for _ in range(2):
        pipeline.run_json(spark, f"{folder}/lines", f"{folder}/out")
    return reports.row_counts({n: spark.read.parquet(f"{folder}/out/ads/{n}") for n in METRICS})


# The names and outcomes of the first six, the read paths of the contract; then further statements of each kind.
STATEMENTS = {
    "dau": ("SELECT dt, server_id, dau, metric_id FROM ads.ads_dau_di WHERE metric_id = 'ads_dau_di' ORDER BY dt, server_id", True),
    "pay_rate": ("SELECT dt, server_id, dau, pay_users, pay_rate, metric_id FROM ads.ads_pay_rate_di WHERE metric_id = 'ads_pay_rate_di' ORDER BY dt, server_id", True),
    "block_unknown_column": ("SELECT not_a_real_col FROM ads.ads_dau_di", False),
    "block_unknown_table": ("SELECT * FROM ads.ads_not_on_allowlist", False),
    "cross_db_same_name": ("SELECT dau FROM hive.ads_dau_di", False),
    "block_delete": ("DELETE FROM ads.ads_dau_di", False),
    "bare_name": ("SELECT MAX(arpu_cny) FROM ads_arpu_di", True),
    "comment": ("SELECT dau FROM /* the table */ ads.ads_dau_di -- ads.secret", True),
    "literal": ("SELECT 'FROM ads.secret' AS t, ads.ads_dau_di.dau FROM ads.ads_dau_di", True),
    "join": ("SELECT a.dau, c.active_7d_users FROM ads.ads_dau_di a JOIN ads_churn_di c USING (dt, server_id)", True),
    "insert": ("INSERT INTO ads.ads_dau_di SELECT * FROM ads.ads_dau_di", False),
    "update": ("UPDATE ads.ads_dau_di SET dau = 1", False),
    "drop": ("DROP TABLE ads.ads_dau_di", False),
    "static_method": ("SELECT reflect('java.lang.System', 'exit', 0) FROM ads.ads_dau_di", False),
    "java_method": ("SELECT java_method('java.lang.System', 'getenv', 'HOME') FROM ads.ads_dau_di", False),
    "nested_function": ("SELECT dau FROM ads.ads_dau_di WHERE dau > (SELECT MAX(length(input_file_name())) FROM ads.ads_dau_di)", False),
    "sample": ("SELECT dau FROM ads.ads_dau_di TABLESAMPLE (5 ROWS)", False),
    "hidden_column": ("SELECT window_complete FROM ads.ads_retention_nd", False),
}


def guard_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(name, guard.check(spark, sql).allowed) for name, (sql, _) in STATEMENTS.items()], "path string, allowed boolean")


def metric_dims(spark: SparkSession, d: str) -> DataFrame:
    """Which of the dimensions each metric may be cut by."""
    rows = [(m, dim, dim in guard.allowed_dims(m)) for m in METRICS for dim in (*ALLOWED_DIMS, "player_id")]
    return spark.createDataFrame(rows, "metric_id string, dim string, allowed boolean")


def clock_skew(spark: SparkSession, d: str) -> DataFrame:
    return reports.clock_skew(sources.table(spark, d, "kafka_g3_events"), "tag", "event_time", "produce_ts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (ndjson_scan, serving_table, serving_dead_letters, jdbc_dau, pipeline_reload, guard_verdicts, metric_dims, clock_skew)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    texts = core_sql.oracle_sql()
    dims = {m: ("dt", "server_id") for m in METRICS} | {"ads_retention_nd": ("cohort_dt", "server_id", "n_days"), "ads_dungeon_clear_rate_di": ("dt", "server_id", "dungeon_id")}
    allowed = ", ".join(f"('{m}', '{x}')" for m, xs in dims.items() for x in xs)
    names, every = ", ".join(f"('{m}')" for m in dims), ", ".join(f"('{x}')" for x in ("dt", "server_id", "dungeon_id", "n_days", "cohort_dt", "player_id"))
    verdicts = ", ".join(f"('{name}', {str(ok).upper()})" for name, (_, ok) in STATEMENTS.items())
    dead = "SELECT {0} AS batch, CASE WHEN dau IS NULL THEN 'missing or bad dau' ELSE 'missing or bad metric_id' END AS error FROM ads_dau_di WHERE (dau IS NULL OR metric_id IS NULL){1}"
    return {
        "ndjson_scan": texts["ods_json_scan"],
        "serving_table": "SELECT dt, server_id, dau + 1 AS dau, metric_id FROM ads_dau_di WHERE dau % 2 = 0 AND metric_id IS NOT NULL",
        "serving_dead_letters": f"SELECT CAST(batch AS INTEGER) AS batch, error, COUNT(*) AS records FROM ({dead.format(0, '')} UNION ALL {dead.format(1, ' AND COALESCE(dau % 2, 0) = 0')}) GROUP BY ALL",
        "jdbc_dau": f"SELECT * FROM ({texts['ads_dau_di']}) WHERE server_id IS NOT NULL",
        "pipeline_reload": texts["ads_row_counts"],
        "guard_verdicts": f"SELECT * FROM (VALUES {verdicts}) t(path, allowed)",
        "metric_dims": f"SELECT m AS metric_id, x AS dim, (m, x) IN ({allowed}) AS allowed FROM (VALUES {names}) a(m), (VALUES {every}) b(x)",
        "clock_skew": """SELECT tag, COUNT(ms) AS pairs, MIN(ms) AS least_ms, GREATEST(-MIN(ms), 0.0) AS ahead_ms FROM (
          SELECT tag, CAST(epoch_us(produce_ts) - epoch_us(event_time) AS DOUBLE) / 1000 AS ms FROM kafka_g3_events) GROUP BY tag""",
    }
