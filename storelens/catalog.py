"""All registered queries of the store engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators import cdc, clicks, quality, sinks, snapshots
from storelens.oracles import ORACLE_SQL
from storelens.plans import build, live, marts, refresh, serve
from storelens.sources import adapters
from storelens.sources.files import inbox
from storelens.sources.inputs import Arrived, Source
from storelens.sources.tables import csv_strings, parquet_or_empty, partitioned_since, table
from storelens.streaming import replays

Query = Callable[[SparkSession, str], DataFrame]

__all__ = ["ORACLE_SQL", "QUERIES"]

CUSTOMER = PRODUCT = 42


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    """Money as double, for comparison across engines."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    """Sentinel times as text: year 9999 does not fit into nanoseconds."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


_CORE = ["order_id", "customer_id", "session_id", "status", "payment_method", "shipping_fee", "order_total", "ship_province", "placed_at"]


def _order_messages(s: SparkSession, d: str) -> DataFrame:
    return cdc.parse_envelopes(cdc.to_envelopes(adapters.order_changes(s, d), "orders"))


def _cdc_envelope(s: SparkSession, d: str) -> DataFrame:
    parsed = _order_messages(s, d)
    return parsed.select("table_name", "op", "ts_ms", "kafka_offset", F.col("before_json").isNotNull().alias("has_before"), F.col("after_json").isNotNull().alias("has_after"))


def _orders_latest(s: SparkSession, d: str) -> DataFrame:
    log = cdc.changes(adapters.order_changes(s, d))
    return _doubles(cdc.live(log, "order_id").select(*_CORE, "changed_at"), "shipping_fee", "order_total")


def _current_versions(s: SparkSession, d: str) -> DataFrame:
    sides = [(marts.dim_customers(s, d), "customer"), (marts.dim_products(s, d), "product")]
    a, b = (df.where("is_current").select(F.lit(name).alias("dim"), F.col(f"{name}_id").alias("id"), "version") for df, name in sides)
    return a.unionByName(b)


def _pit_customer(s: SparkSession, d: str) -> DataFrame:
    orders = marts.order_core(s, d).select("order_id", "customer_id", "placed_at")
    return cdc.as_of(orders, marts.dim_customers(s, d), "customer_id", "placed_at", ["version", "province"]).drop("placed_at")


def _order_items(s: SparkSession, d: str) -> DataFrame:
    return _doubles(marts.fct_order_items(s, d), "unit_price", "line_revenue", "unit_cost_at_sale", "line_margin")


def _fct_orders(s: SparkSession, d: Source) -> DataFrame:
    return _doubles(marts.fct_orders(s, d), "items_value", "shipping_fee", "order_total")


def _standardised(s: SparkSession, d: str) -> DataFrame:
    return quality.standardise(adapters.deliveries_raw(s, d))


def _upserts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The events stored so far, and all events, which arrive again."""
    events = table(s, d, "events").select("event_id", "ts")
    return events.where("ts < '2024-01-16'").select("event_id", F.lit("old").alias("origin")), events.withColumn("origin", F.lit("new"))


def _upsert_ignore(s: SparkSession, d: str) -> DataFrame:
    old, new = _upserts(s, d)
    new = new.drop("ts")
    return old.unionByName(sinks.merge_ignore(old, new.unionByName(new), ["event_id"], ["origin"]))


def _upsert_update(s: SparkSession, d: str) -> DataFrame:
    """Events from the tenth on arrive; those stored before stay."""
    old, new = _upserts(s, d)
    return sinks.merge_update(old, new.where("ts >= '2024-01-10'").drop("ts"), ["event_id"], ["origin"])


def _pending(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "orders").select(F.concat(F.lit("orders_"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".csv")).alias("file_name")).distinct()
    ledger = files.where("substr(file_name, 8, 4) < '1999'")
    return sinks.pending_files(files.unionByName(s.range(1).select(F.lit(".part.csv").alias("file_name"))), ledger)


def _typed(s: SparkSession, log: DataFrame, name: str) -> DataFrame:
    """Changes through messages and back, the same for each table."""
    return cdc.typed(cdc.parse_envelopes(cdc.to_envelopes(log, name)), name)


def _approx_errors(s: SparkSession, d: str) -> DataFrame:
    """Cells whose approximate sessions are off by more than three standard errors of the sketch, and one."""
    keys = ["window_start", "stage"]
    exact, close = (clicks.funnel_windows(adapters.clicks(s, d), exact=e).select(*keys, F.col("sessions").alias(n)) for e, n in ((True, "sessions"), (False, "approx")))
    return exact.join(close, keys).where("abs(approx - sessions) > greatest(1, 0.15 * sessions)")


def _error_classes(s: SparkSession, d: str) -> DataFrame:
    """Cells by the error of their approximate sessions; those of full hours are made wrong on purpose, and must be found."""
    keys = ["window_start", "stage"]
    exact, close = (clicks.funnel_windows(adapters.clicks(s, d), exact=e).select(*keys, F.col("sessions").alias(n)) for e, n in ((True, "sessions"), (False, "approx")))
    planted = F.when(F.minute("window_start") == 0, F.col("approx") * 2 + 10).otherwise(F.col("approx"))
    error = F.when(F.abs(planted - F.col("sessions")) > F.greatest(F.lit(1), 0.15 * F.col("sessions")), "off").otherwise("within")
    return exact.join(close, keys).groupBy(error.alias("error")).agg(F.count("*").alias("cells"))


def _folder_or_missing(s: SparkSession, d: str) -> DataFrame:
    """Events of a landed folder, and of one that no stream has written yet."""
    root = replays.folder(s, "landed")
    table(s, d, "events").select("event_id", F.col("ts").cast("date").alias("day")).write.parquet(f"{root}/events")
    found = s.read.parquet(f"{root}/events")
    both = parquet_or_empty(s, f"{root}/events", found.schema).unionByName(parquet_or_empty(s, f"{root}/late_events", found.schema))
    return both.groupBy("day").agg(F.count("*").alias("events"))


def _several_current(s: SparkSession, d: str) -> DataFrame:
    """Customers of whom every version but a deletion is marked current."""
    marked = cdc.versions(cdc.changes(adapters.customer_changes(s, d)), "customer_id").withColumn("is_current", ~F.col("is_deleted"))
    return quality.several_current(customer=(marked, "customer_id"))


def _unmasked(s: SparkSession, d: str) -> DataFrame:
    """Customers whose address was put in unmasked: those who opted in."""
    dims = marts.dim_customers(s, d)
    return quality.unmasked(dims.withColumn("email_masked", F.when(F.col("marketing_opt_in"), F.regexp_replace("email_masked", r"\*", "x")).otherwise(F.col("email_masked")))).select("customer_sk")


def _freshness(s: SparkSession, d: str) -> DataFrame:
    """The age of the click source by its last arrival, at three moments after it."""
    loaded = adapters.clicks(s, d)
    last = loaded.agg(F.date_trunc("day", F.max("ingested_at")).cast("timestamp_ntz").alias("day"))
    rows = None
    for name, hours in (("soon", 25), ("later", 30), ("days", 72)):
        one = quality.stale(loaded, "ingested_at", last.select(F.col("day") + F.expr(f"interval {hours} hours")).scalar(), "2 hours", "24 hours").select(F.lit(name).alias("moment"), "state")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _csv_orders(s: SparkSession, d: str) -> DataFrame:
    """Orders as CSV files, read back as strings."""
    root = replays.folder(s, "csv")
    table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), F.format_string("say \"%s\", ok", F.col("o_orderstatus")).alias("note")).write.option("escape", '"').option("header", True).csv(root)
    rows = csv_strings(s, root, ["o_orderkey", "o_orderpriority", "note"])
    return rows.withColumn("from_csv", F.col("source_file").endswith(".csv")).drop("source_file")


def _events_since(s: SparkSession, d: str) -> DataFrame:
    """Events by day in folders, from a day on."""
    root = replays.folder(s, "hive")
    table(s, d, "events").select("event_id", F.col("ts").cast("date").alias("day")).write.partitionBy("day").parquet(root)
    return partitioned_since(s, root, "day", "2024-01-20").groupBy("day").agg(F.count("*").alias("events"))


def _overwritten_days(s: SparkSession, d: str) -> DataFrame:
    """Sessions by day; ten days are then replaced by those of their sessions that bought, on working days only."""
    root = replays.folder(s, "days")
    rolled = marts.sessions(s, d).select("session_id", "purchases", "session_date")
    sinks.overwrite_partitions(rolled, root, "session_date", "2023-01-01", "2025-01-01")
    within = F.col("session_date").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-19").cast("date"))
    sinks.overwrite_partitions(rolled.where(within & (F.col("purchases") > 0) & (F.weekday("session_date") < 5)), root, "session_date", "2024-01-10", "2024-01-19")
    return s.read.parquet(root).groupBy("session_date").agg(F.count("*").alias("sessions"))


def _upserted_table(s: SparkSession, d: str) -> DataFrame:
    """Orders placed before 1998 stored, all orders ignored where stored, then late ones updated: what each step reports and leaves."""
    root = replays.folder(s, "upsert")
    orders = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    step = lambda name, rows: rows.select("o_orderkey", F.lit(name).alias("origin"))
    early, late = orders.where("o_orderdate < '1998-01-01'"), orders.where("o_orderdate >= '2000-01-01'")
    n = [sinks.upsert(step("first", early), root, ["o_orderkey"], ["origin"]), sinks.upsert(step("second", orders.unionByName(orders)), root, ["o_orderkey"], ["origin"]), sinks.upsert(step("third", late), root, ["o_orderkey"], ["origin"], update=True)]
    reported = s.createDataFrame(list(zip(("first", "second", "third"), n, strict=True)), "origin string, reported long")
    return sinks.keyed(s, root).groupBy("origin").agg(F.count("*").alias("orders")).join(F.broadcast(reported), "origin")


def _published(s: SparkSession, d: str) -> DataFrame:
    """A mart rebuilt twice; readers get the last whole one."""
    root = replays.folder(s, "mart")
    board = live.status_board(s, d)
    versions = [sinks.publish(board.where("status = 'PLACED'"), root), sinks.publish(board, root)]
    return sinks.current(s, root).withColumn("version", F.lit(versions[-1]))


def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    """Rows of every table of the warehouse after a rebuild, as its readers see them."""
    root = replays.folder(s, "warehouse")
    versions = build.rebuild(s, d, root)
    rows = None
    for name, version in versions.items():
        one = build.read(s, root, name).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(version).alias("version"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Three tables committed together, then one of them alone: what a reader of the last snapshot has."""
    root = replays.folder(s, "snapshots")
    first = build.commit(s, d, root, ("dim_customers", "fct_orders", "sales_daily"))
    build.commit(s, d, root, ("sales_daily",), base=first)
    seen = snapshots.Snapshot(s, root)
    rows = None
    for name in seen.tables:
        one = seen.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(seen.number).alias("snapshot"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _refreshed(s: SparkSession, d: str, name: str) -> DataFrame:
    """A published table after a delivery: every fortieth change and the rows of every fortieth waybill come late, of all times and keys."""
    root = replays.folder(s, "refresh")
    late, billed = (F.pmod(F.xxhash64(*c), F.lit(40)) == 0 for c in (("ts_ms", "kafka_offset"), ("waybill",)))
    refresh.build(s, Arrived(d, ~late, ~billed), root, [name], by="month")
    refresh.refresh(s, d, Arrived(d, late, billed), root, [name])
    return snapshots.Snapshot(s, root).read(name)


def _snapshot(s: SparkSession, d: str, *names: str) -> snapshots.Snapshot:
    """Published tables that lie by key."""
    root = replays.folder(s, "published")
    refresh.build(s, d, root, names, by="month")
    return snapshots.Snapshot(s, root)


def _appended_results(s: SparkSession, d: str) -> DataFrame:
    """Rule results of two runs appended, the second one twice, and their scorecard."""
    root = replays.folder(s, "dq")
    results = quality.rule_results(_standardised(s, d), quality.delivery_rules(), ["waybill", "status"])
    now = F.lit(marts.AS_OF).cast("timestamp_ntz")
    for run in ("a", "b", "b"):
        sinks.append_results(results, root, run, "deliveries", now)
    return quality.scorecard(s.read.parquet(root), now - F.expr("interval 7 days")).drop("last_run_at")


def _inbox(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A partner's files in an inbox, loaded twice over; the tables' folder and what each file loaded."""
    root = replays.folder(s, "inbox")
    rows = adapters.deliveries_raw(s, d).select(*quality.DELIVERY_COLUMNS)
    rows.repartition(2, "waybill").sortWithinPartitions("waybill").write.option("header", True).csv(f"{root}/in")
    now = F.lit(marts.AS_OF).cast("timestamp_ntz")
    first = sinks.ingest_inbox(s, f"{root}/in", f"{root}/archive", f"{root}/tables", now)
    again = sinks.ingest_inbox(s, f"{root}/in", f"{root}/archive", f"{root}/tables", now)
    left = len(inbox(s, f"{root}/in"))
    return f"{root}/tables", s.createDataFrame([(sum(first.values()), sum(again.values()), left, len(inbox(s, f"{root}/archive")) - len(first))], "loaded long, loaded_again long, files_left long, files_lost long")


def _ingested(s: SparkSession, d: str) -> DataFrame:
    """Deliveries, rejected rows and rule failures after an inbox was loaded, and loaded again."""
    tables, counts = _inbox(s, d)
    kept = sinks.keyed(s, f"{tables}/deliveries").agg(F.count("*").alias("deliveries"))
    ledger = s.read.parquet(f"{tables}/ledger").agg(F.sum("rows_rejected").alias("rejected"))
    failures = s.read.parquet(f"{tables}/dq_results").agg(F.sum("failed_rows").alias("failures"))
    return counts.crossJoin(kept).crossJoin(ledger).crossJoin(failures)


def _quarantined(s: SparkSession, d: str) -> DataFrame:
    """Rejected rows as they lie in quarantine."""
    tables, _ = _inbox(s, d)
    return s.read.option("header", True).csv(f"{tables}/quarantine").select("waybill", "courier", "status", "failed_rules")


QUERIES: dict[str, Query] = {
    "clicks_parsed": lambda s, d: clicks.parse_messages(clicks.to_messages(adapters.clicks(s, d))).drop("cart_value", "order_id", "items"),
    "clicks_dedup": lambda s, d: clicks.dedupe(adapters.clicks(s, d, repeated=True)).select("event_id", "event_time", "session_id", "event_type"),
    "sessions": marts.sessions,
    "late_events": lambda s, d: marts.sessions(s, d).groupBy("session_date").agg(F.sum("late_events").alias("late_events"), F.sum("events").alias("events")),
    "funnel_windows": lambda s, d: clicks.funnel_windows(adapters.clicks(s, d)),
    "funnel_windows_approx": lambda s, d: clicks.funnel_windows(adapters.clicks(s, d), exact=False),
    "active_sessions_per_minute": lambda s, d: clicks.funnel_windows(adapters.clicks(s, d)).where("stage = 'any'").select("window_start", "sessions"),
    "funnel_dense_series": lambda s, d: serve.live_funnel(s, d, "2024-01-15 12:00:00", 360),
    "carts_abandoned": marts.carts,
    "carts_value_by_day": lambda s, d: live.alerts_by_day(marts.carts(s, d)),
    "carts_recovered_24h": marts.carts_recovered,
    "abandoned_carts_daily": marts.abandoned_carts_daily,
    "cdc_envelope": _cdc_envelope,
    "cdc_orders_typed": lambda s, d: _doubles(cdc.typed(_order_messages(s, d), "orders"), "shipping_fee", "order_total"),
    "orders_latest": _orders_latest,
    "orders_milestones": lambda s, d: cdc.milestones(cdc.changes(adapters.order_changes(s, d))),
    "orders_previous_status": lambda s, d: live.order_log(s, d).select("order_id", "ts_ms", "kafka_offset", "status", "previous_status"),
    "order_items_latest": lambda s, d: _doubles(marts.order_lines(s, d).select("order_id", "product_id", "quantity", "unit_price"), "unit_price"),
    "order_item_rollup": lambda s, d: _doubles(marts.item_rollup(s, d), "items_value"),
    "dim_customers_scd2": lambda s, d: _texts(marts.dim_customers(s, d), "valid_from", "valid_to"),
    "dim_products_scd2": lambda s, d: _texts(_doubles(marts.dim_products(s, d), "price", "cost"), "valid_from", "valid_to"),
    "dim_current_versions": _current_versions,
    "dim_date": marts.dim_date,
    "pit_customer": _pit_customer,
    "pit_product_margin": lambda s, d: _order_items(s, d).select("order_id", "product_id", "unit_cost_at_sale", "line_margin"),
    "fct_orders": _fct_orders,
    "fct_order_items": _order_items,
    "fct_sessions": lambda s, d: _doubles(marts.fct_sessions(s, d), "order_total"),
    "sales_daily": marts.sales_daily,
    "sales_recent_days": lambda s, d: serve.sales_daily(s, d, 365),
    "funnel_daily": marts.funnel_daily,
    "funnel_by_day": serve.funnel_by_day,
    "funnel_by_source": serve.funnel_by_source,
    "delivery_latest": marts.delivery_latest,
    "delivery_sla": marts.delivery_sla,
    "delivery_sla_weighted": serve.delivery_sla_weighted,
    "rfm_scores": lambda s, d: marts.rfm(s, d).drop("first_name", "province", "segment"),
    "rfm_segments": marts.rfm,
    "segment_summary": serve.segments,
    "dq_rule_results": lambda s, d: quality.rule_results(_standardised(s, d), quality.delivery_rules(), ["waybill", "status"]),
    "dq_rejected": lambda s, d: quality.checked(_standardised(s, d), quality.delivery_rules()).where("failed_rules <> ''").select("waybill", "courier", "status", "attempts", "failed_rules"),
    "dq_duplicates": lambda s, d: quality.not_unique(quality.checked(_standardised(s, d), quality.delivery_rules()).where("failed_rules = ''"), "waybill", "status"),
    "dq_scorecard": marts.dq_scorecard,
    "live_status_board": live.status_board,
    "live_day_kpis": live.day_kpis,
    "live_recent_orders": live.recent_orders,
    "live_top_products": live.top_products,
    "live_low_stock": live.low_stock,
    "live_display_names": live.display_names,
    "live_recent_alerts": serve.recent_alerts,
    "live_best_sellers": lambda s, d: serve.best_sellers(s, d, "1998-10-03", "units"),
    "live_lowest_stock": serve.lowest_stock,
    "live_overview": lambda s, d: serve.overview(s, d, "1998-10-03"),
    "price_history": lambda s, d: serve.price_history(s, d, PRODUCT),
    "customer_profile": lambda s, d: serve.customer_profile(s, d, CUSTOMER),
    "customer_history": lambda s, d: serve.customer_history(s, d, CUSTOMER),
    "customer_recent_orders": lambda s, d: serve.customer_recent_orders(s, d, CUSTOMER),
    "pii_masked": lambda s, d: marts.dim_customers(s, d).select("customer_sk", "email_masked", "phone_masked"),
    "upsert_ignore": _upsert_ignore,
    "upsert_update": _upsert_update,
    "ledger_pending_files": _pending,
    "assert_unique": lambda s, d: quality.not_unique(table(s, d, "lineitem"), "l_orderkey", "l_linenumber"),
    "assert_not_null": lambda s, d: quality.is_null(marts.dim_customers(s, d), "phone_masked").select("customer_sk"),
    "assert_accepted": lambda s, d: quality.not_accepted(marts.order_core(s, d), "status", ("PLACED", "PAID", "SHIPPED")).select("order_id", "status"),
    "assert_between": lambda s, d: quality.outside(marts.dim_products(s, d), "margin_pct", 0.4, 1.0).select("product_sk", "margin_pct"),
    "assert_one_current": lambda s, d: quality.several_current(customer=(marts.dim_customers(s, d), "customer_id"), product=(marts.dim_products(s, d), "product_id")),
    "assert_totals_match": lambda s, d: _fct_orders(s, d).where("lines > 0 and abs(order_total - (items_value + shipping_fee)) > 0.01").select("order_id", "order_total", "items_value", "shipping_fee"),
    "assert_no_pii": lambda s, d: quality.unmasked(marts.dim_customers(s, d)).select("customer_sk"),
    "assert_price_between": lambda s, d: _doubles(quality.outside(marts.dim_products(s, d), "price", 1000, 90000).select("product_sk", "price"), "price"),
    "assert_several_current": _several_current,
    "assert_unmasked_pii": _unmasked,
    "approx_error_classes": _error_classes,
    "source_folder_or_missing": _folder_or_missing,
    "assert_funnel_monotonic": lambda s, d: marts.funnel_daily(s, d).where("not (added_to_cart >= reached_checkout and reached_checkout >= purchased)"),
    "cdc_order_items_typed": lambda s, d: _doubles(_typed(s, adapters.order_item_changes(s, d), "order_items"), "unit_price"),
    "cdc_customers_typed": lambda s, d: _typed(s, adapters.customer_changes(s, d), "customers"),
    "cdc_products_typed": lambda s, d: _doubles(_typed(s, adapters.product_changes(s, d), "products"), "price", "cost"),
    "cdc_inventory_typed": lambda s, d: _typed(s, adapters.inventory_changes(s, d), "inventory"),
    "abandoned_recent_days": serve.abandoned_daily,
    "data_quality": serve.data_quality,
    "live_overview_clicks": lambda s, d: serve.overview(s, d, "2024-01-15", "2024-01-15 12:00:00"),
    "live_retained_cells": lambda s, d: live.retained(clicks.funnel_windows(adapters.clicks(s, d)), "window_start", "2024-01-15 12:00:00", "funnel").where("window_start < '2024-01-15 12:00:00'"),
    "assert_approx_close": _approx_errors,
    "source_freshness": _freshness,
    "source_csv_strings": _csv_orders,
    "source_partitions_since": _events_since,
    "source_missing_folder": lambda s, d: parquet_or_empty(s, f"{d}/no_such_table.parquet", table(s, d, "region").schema),
    "sink_overwrite_days": _overwritten_days,
    "sink_upsert_table": _upserted_table,
    "sink_published_mart": _published,
    "sink_rebuilt_warehouse": _rebuilt,
    "sink_snapshots": _snapshots,
    "sink_dq_results": _appended_results,
    "published_profile": lambda s, d: serve.published_profile(_snapshot(s, d, "customer_rfm"), CUSTOMER),
    "published_history": lambda s, d: serve.published_history(_snapshot(s, d, "dim_customers"), CUSTOMER),
    "published_recent_orders": lambda s, d: serve.published_recent_orders(_snapshot(s, d, "customer_orders"), CUSTOMER),
    "published_price_history": lambda s, d: serve.published_prices(_snapshot(s, d, "dim_products"), PRODUCT),
    "refreshed_fct_orders": lambda s, d: _doubles(_refreshed(s, d, "fct_orders"), "items_value", "shipping_fee", "order_total"),
    "refreshed_fct_order_items": lambda s, d: _doubles(_refreshed(s, d, "fct_order_items"), "unit_price", "line_revenue", "unit_cost_at_sale", "line_margin"),
    "refreshed_dim_products": lambda s, d: _texts(_doubles(_refreshed(s, d, "dim_products"), "price", "cost"), "valid_from", "valid_to"),
    "refreshed_sales_daily": lambda s, d: _refreshed(s, d, "sales_daily"),
    "refreshed_customer_rfm": lambda s, d: _refreshed(s, d, "customer_rfm"),
    "sink_ingest_inbox": _ingested,
    "sink_rejected_rows": _quarantined,
    "stream_bronze": replays.bronze,
    "stream_funnel_late": lambda s, d: replays.funnel(s, d, late=True),
    "stream_change_counts": replays.change_counts,
    "stream_funnel": replays.funnel,
    "stream_carts": replays.carts,
    "stream_cdc": replays.cdc,
    "stream_fct_orders": lambda s, d: _fct_orders(s, replays.landed(s, d, "orders", "order_items", "customers")),
    "stream_status_board": replays.status_board,
    "stream_day_kpis": replays.day_kpis,
    "stream_recent_orders": replays.recent_orders,
    "stream_top_products": replays.top_products,
    "stream_low_stock": replays.low_stock,
    "stream_product_cards": replays.product_cards,
    "stream_customer_cards": replays.customer_cards,
    "live_product_cards": lambda s, d: _doubles(live.product_cards(s, d), "price"),
    "live_customer_cards": live.customer_cards,
}
