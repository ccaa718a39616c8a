"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; its time is the
median, from building the plan to the last row written to a sink that drops
them.  `star_*` queries start from the raw star tables, `release_*` queries
from a prepared release, which is how the published figures were taken.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from obsmill.operators.trade import trade_balance  # noqa: E402
from obsmill.plans import queries, reports  # noqa: E402
from obsmill.schema import PRODUCTION  # noqa: E402
from obsmill.session import sound_unions  # noqa: E402
from obsmill.sources import star  # noqa: E402
from obsmill.sources.release import ReleaseStore  # noqa: E402
from obsmill.sources.workspace import new_folder  # noqa: E402
from obsmill.tables import PreparedTables  # noqa: E402

STAR = (
    "select_observations",
    "annual_prices",
    "availability",
    "weighted_yield_by_year",
    "weighted_yield_by_area_year",
    "production_by_area_year",
    "total_by_year",
    "yoy_change",
    "period_change",
    "world_ranking",
    "rank_all_years",
    "shares_and_ranks",
    "top_n_ranking",
    "production_share",
    "trade_balance",
    "trade_by_item",
    "trade_series",
    "price_series",
    "history_series_rollup",
    "country_comparison",
    "kpi_summary",
    "partition_manifest",
    "release_rows",
    "literal_search",
    "formula_safe",
    "url_host_filter",
    "question_intents",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sound_unions(spark)
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work, runs: int) -> float:
    work()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        work()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def release_work(spark: SparkSession, folder: str):
    """The views with published figures, over a prepared release."""
    store = ReleaseStore(spark, new_folder(spark, "bench"))
    observations = star.observations(spark, folder)
    store.publish(observations, queries._metadata(spark, folder, observations))
    tables = PreparedTables(store)
    years = (1995, 2001)
    areas, items = queries.AREAS[:1], queries.ITEMS[:1]
    countries = queries._countries(spark, folder)

    def select(code):
        # Three areas and two items over the whole period, as in the published figures.
        return lambda: drain(tables.query(code, queries.AREAS[:3], queries.ITEMS[:2], years=years))

    def country_crop_view():
        drain(tables.key_figures(countries, areas, items, years))
        drain(reports.history_series(tables.query("QCL", areas, items, years=years), PRODUCTION))

    def trade_price_tab():
        rows = tables.query("TCL", areas, items, years=years)
        drain(reports.trade_series(rows))
        drain(trade_balance(rows))
        drain(reports.price_series(tables.query("PP", areas, items, years=years)))

    return {
        "release_select_qcl": select("QCL"),
        "release_select_pp": select("PP"),
        "release_select_tcl": select("TCL"),
        "release_country_crop_view": country_crop_view,
        "release_trade_price_tab": trade_price_tab,
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    registry = queries.registry()
    times = {
        f"star_{name}": timed(lambda n=name: drain(registry[n](spark, folder)), runs) for name in STAR
    }
    for name, work in release_work(spark, folder).items():
        times[name] = timed(work, runs)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
