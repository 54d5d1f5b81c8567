"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads.
"""

from __future__ import annotations

import json
import os
import time

#: One of each kind: calendar mart, rollups, versions, point-in-time facts, tiles, percentiles, rules, live views.
HEADLINE = (
    "sales_daily", "sessions", "funnel_windows", "funnel_daily", "carts_abandoned", "abandoned_carts_daily", "cdc_orders_typed", "orders_latest", "dim_customers_scd2",
    "dim_products_scd2", "fct_orders", "fct_order_items", "delivery_sla", "rfm_segments", "dq_rule_results", "live_status_board", "live_top_products",
)


def main() -> None:
    from storelens import catalog
    from storelens.session import session

    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{cpus}]", cpus, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["late_events"](spark, sf_dir).toPandas()  # starts the JVM's and Python's machinery
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).toPandas()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
