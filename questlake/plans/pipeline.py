"""The whole batch run: raw events to clean events, aggregates and the seven metrics, each a parquet table.

    python -m questlake.plans.pipeline RAW OUT [--json]

RAW is a parquet table of ODS columns, or with --json a folder of JSON lines. Every
table under OUT is replaced as a whole. With --from-dwd RAW is a clean table and the
run starts at the aggregates (backfill).
"""

from __future__ import annotations

import sys
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from questlake.operators import layers, metrics, reports
from questlake.sources.ods import flatten, read_ndjson
from questlake.workspace import materialise


def run(spark: SparkSession, raw: DataFrame, out: str, from_dwd: bool = False) -> dict[str, float]:
    """Write all layers; seconds per stage. Independent tables are written at the same time.

    Clean events and the aggregates are read by several tables each, so they are
    materialised once and read from there.
    """
    at = [time.time()]
    done = lambda: at.append(time.time())
    dwd = raw if from_dwd else materialise(layers.clean(raw), f"{out}/dwd/player_events_clean")
    done()
    with ThreadPoolExecutor(8) as pool:

        def write(item: tuple[str, DataFrame]) -> tuple[str, DataFrame]:
            return item[0], materialise(item[1], f"{out}/{item[0]}")

        dws = dict(pool.map(write, {"dws/player_behavior_di": layers.player_day(dwd), "dws/dungeon_behavior_di": layers.dungeon_day(dwd), "dws/player_first_seen": layers.first_seen(dwd)}.items()))
        done()
        tables = metrics.all_metrics(dws["dws/player_behavior_di"], dws["dws/dungeon_behavior_di"])
        list(pool.map(write, {f"ads/{name}": df for name, df in tables.items()}.items()))
        done()
    names = ("ods_dwd", "dws", "ads")
    return {n: round(b - a, 3) for n, a, b in zip(names, at, at[1:])} | {"total": round(at[-1] - at[0], 3)}


def run_json(spark: SparkSession, lines: str, out: str) -> dict[str, float]:
    """``run`` from JSON lines: they are parsed once, and the raw layer is a table of its own."""
    began = time.time()
    raw = materialise(read_ndjson(spark, lines), f"{out}/ods/player_events")
    parsed = round(time.time() - began, 3)
    stages = run(spark, raw, out)
    return {"json_ods": parsed} | stages | {"total": round(parsed + stages["total"], 3)}


def summary(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """DAU by day, and the averages of pay rate and ARPU."""
    ads = {n: spark.read.parquet(f"{out}/ads/{n}") for n in ("ads_dau_di", "ads_pay_rate_di", "ads_arpu_di")}
    return reports.dau_by_day(ads["ads_dau_di"]).orderBy("dt"), reports.pay_arpu(ads["ads_pay_rate_di"], ads["ads_arpu_di"])


def main(args: list[str]) -> None:
    from questlake.session import get_session

    flags, (source, out) = {a for a in args if a.startswith("--")}, [a for a in args if not a.startswith("--")]
    spark = get_session("questlake-pipeline")
    if "--json" in flags:
        print(run_json(spark, source, out))
    else:
        raw = spark.read.parquet(source)
        print(run(spark, raw if "--from-dwd" in flags else flatten(raw), out, "--from-dwd" in flags))
    for df in summary(spark, out):
        df.show(100, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
