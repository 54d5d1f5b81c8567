"""Parameterised reads of the marts and live views; bounds as the service had them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.scalars import OPEN_FROM, OPEN_TO, ratio, timestamp_ntz
from storelens.operators import clicks
from storelens.operators.snapshots import Snapshot
from storelens.plans import live, marts, refresh
from storelens.sources import inputs
from storelens.sources.inputs import Source


def bounded(value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{value} is not within {low} to {high}")
    return value


def _recent(df: DataFrame, column: str, days: int, as_of: str) -> DataFrame:
    return df.where(F.col(column) > F.date_sub(F.lit(as_of).cast("date"), days))


def sales_daily(spark: SparkSession, sf_dir: Source, days: int = 30, as_of: str = marts.AS_OF) -> DataFrame:
    return _recent(marts.sales_daily(spark, sf_dir, as_of), "order_date", bounded(days, 1, 365), as_of).orderBy("order_date")


def funnel_by_day(spark: SparkSession, sf_dir: Source, days: int = 30, as_of: str = "2024-01-31") -> DataFrame:
    found = _recent(marts.funnel_daily(spark, sf_dir), "session_date", bounded(days, 1, 90), as_of)
    return found.groupBy("session_date").agg(*(F.sum(c).alias(c) for c in ("sessions", "viewed_product", "added_to_cart", "reached_checkout", "purchased", "abandoned_carts"))).orderBy("session_date")


def funnel_by_source(spark: SparkSession, sf_dir: Source, days: int = 90, as_of: str = "2024-01-31") -> DataFrame:
    found = _recent(marts.funnel_daily(spark, sf_dir), "session_date", bounded(days, 1, 90), as_of)
    summed = found.groupBy("traffic_source").agg(F.sum("sessions").alias("sessions"), F.sum("purchased").alias("purchased"))
    return summed.withColumn("conversion_rate", ratio(F.col("purchased"), F.col("sessions"))).orderBy(F.desc_nulls_last("conversion_rate"))


def delivery_sla_weighted(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """By courier; the averages are those of rounded averages, as the service reported them."""
    d = marts.delivery_sla(spark, sf_dir)
    n = F.sum("deliveries")
    weigh = lambda c: F.sum((F.col(c) * F.col("deliveries")).cast("decimal(24,4)"))
    return d.groupBy("courier").agg(n.alias("deliveries"), ratio(weigh("avg_hours"), n, 1).alias("avg_hours"), ratio(weigh("sla_rate"), n).alias("sla_rate")).orderBy(F.desc("sla_rate"))


def segments(spark: SparkSession, sf_dir: Source) -> DataFrame:
    r = marts.rfm(spark, sf_dir)
    return r.groupBy("segment").agg(F.count("*").alias("customers"), F.sum(F.col("monetary").cast("decimal(18,2)")).cast("double").alias("revenue"), ratio(F.sum("recency_days"), F.count("*"), 1).alias("avg_recency_days")).orderBy(F.desc("revenue"))


def open_ended(df: DataFrame) -> DataFrame:
    """Sentinel validity as null."""
    return df.withColumns({"valid_from": F.nullif("valid_from", timestamp_ntz(OPEN_FROM)), "valid_to": F.nullif("valid_to", timestamp_ntz(OPEN_TO))})


def _profile(versions: DataFrame, scores: DataFrame) -> DataFrame:
    own = versions.where("is_current").select("customer_id", "first_name", "last_initial", "email_masked", "province", "city", "marketing_opt_in", "version")
    return own.join(scores.select("customer_id", "segment", "recency_days", "frequency", "monetary"), "customer_id", "left")


def _history(versions: DataFrame) -> DataFrame:
    return open_ended(versions).select("version", "province", "city", "marketing_opt_in", "valid_from", "valid_to").orderBy("version")


def _recent_orders(orders: DataFrame, limit: int) -> DataFrame:
    return orders.orderBy(F.desc("placed_at"), F.desc("order_id")).limit(limit).select("order_id", "placed_at", "status", F.col("order_total").cast("double").alias("order_total"), "courier", "delivery_hours")


def _prices(versions: DataFrame) -> DataFrame:
    doubles = [F.col(c).cast("double").alias(c) for c in ("price", "cost")]
    return open_ended(versions).select("version", "product_name", *doubles, "margin_pct", "is_current", "valid_from", "valid_to").orderBy("version")


def customer_profile(spark: SparkSession, sf_dir: Source, customer_id: int) -> DataFrame:
    """No row for an unknown customer."""
    return _profile(marts.dim_customers(spark, sf_dir).where(F.col("customer_id") == customer_id), marts.rfm(spark, sf_dir))


def customer_history(spark: SparkSession, sf_dir: Source, customer_id: int) -> DataFrame:
    return _history(marts.dim_customers(spark, sf_dir).where(F.col("customer_id") == customer_id))


def customer_recent_orders(spark: SparkSession, sf_dir: Source, customer_id: int, limit: int = 10) -> DataFrame:
    return _recent_orders(marts.fct_orders(spark, sf_dir).where(F.col("customer_id") == customer_id), limit)


def price_history(spark: SparkSession, sf_dir: Source, product_id: int) -> DataFrame:
    return _prices(marts.dim_products(spark, sf_dir).where(F.col("product_id") == product_id))


# The same reads of published tables: one bucket of each, and no log.


def published_profile(snapshot: Snapshot, customer_id: int) -> DataFrame:
    """No row for an unknown customer."""
    return _profile(refresh.of_key(snapshot, "dim_customers", customer_id), refresh.of_key(snapshot, "customer_rfm", customer_id))


def published_history(snapshot: Snapshot, customer_id: int) -> DataFrame:
    return _history(refresh.of_key(snapshot, "dim_customers", customer_id))


def published_recent_orders(snapshot: Snapshot, customer_id: int, limit: int = 10) -> DataFrame:
    return _recent_orders(refresh.of_key(snapshot, "customer_orders", customer_id), limit)


def published_prices(snapshot: Snapshot, product_id: int) -> DataFrame:
    return _prices(refresh.of_key(snapshot, "dim_products", product_id))


def abandoned_daily(spark: SparkSession, sf_dir: Source, days: int = 30, as_of: str = "2024-01-31") -> DataFrame:
    return _recent(marts.abandoned_carts_daily(spark, sf_dir), "cart_date", bounded(days, 1, 90), as_of).orderBy("cart_date")


def data_quality(spark: SparkSession, sf_dir: Source) -> DataFrame:
    return marts.dq_scorecard(spark, sf_dir).orderBy("pass_rate", "dataset", "rule_name")


def _named(df: DataFrame, spark: SparkSession, sf_dir: Source, kind: str, key: str) -> DataFrame:
    names = live.display_names(spark, sf_dir).where(F.col("kind") == kind).select(F.col("id").alias("_id"), "name")
    return df.join(names, F.col(key) == F.col("_id"), "left").drop("_id")


def recent_alerts(spark: SparkSession, sf_dir: Source, limit: int = 20) -> DataFrame:
    """The abandoned carts of last activity, latest first; unknown customers are guests."""
    last = marts.carts(spark, sf_dir).orderBy(F.desc("last_activity_at"), "session_id").limit(bounded(limit, 1, 100))
    named = _named(last, spark, sf_dir, "customer", "customer_id")
    return named.withColumn("name", F.coalesce("name", F.lit("Guest"))).select("session_id", "name", "cart_value", "items", "last_activity_at")


def best_sellers(spark: SparkSession, sf_dir: Source, day: str, by: str = "revenue", limit: int = 10) -> DataFrame:
    """A day's products by revenue or units with their names; ties go to the larger id as text."""
    if by not in ("revenue", "units"):
        raise ValueError(f"products are ranked by revenue or units, not {by}")
    today = live.product_days(spark, sf_dir).where(F.col("day") == F.lit(day).cast("date"))
    top = today.orderBy(F.desc(by), F.col("product_id").cast("string").desc()).limit(bounded(limit, 1, 50))
    return _named(top, spark, sf_dir, "product", "product_id").select("product_id", "name", "units", "revenue")


def lowest_stock(spark: SparkSession, sf_dir: Source, limit: int = 20) -> DataFrame:
    """Products under the threshold, least stock first; ties go to the smaller id as text."""
    low = live.low_stock(spark, sf_dir).orderBy("stock_on_hand", F.col("product_id").cast("string")).limit(bounded(limit, 1, 100))
    return _named(low, spark, sf_dir, "product", "product_id").select("product_id", "name", "stock_on_hand")


def overview(spark: SparkSession, sf_dir: Source, day: str, until: str | None = None) -> DataFrame:
    """One row: a day's orders, revenue, average, items, cancellations and abandoned carts; sessions of the minute ``until``, and orders by status now."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    that = F.lit(day).cast("date")
    today = live.day_kpis(spark, sf_dir).where(F.col("day") == that)
    summed = today.agg(zero(F.sum("orders")).alias("orders"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"), zero(F.sum("cancelled")).alias("cancelled"))
    items = live.product_days(spark, sf_dir).where(F.col("day") == that).agg(zero(F.sum("units")).alias("items_sold"))
    alerts = live.alerts_by_day(marts.carts(spark, sf_dir)).where(F.col("day") == that).agg(zero(F.sum("alerts")).alias("abandoned_carts"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("abandoned_value"))
    minute = F.date_trunc("minute", timestamp_ntz(until or f"{day} 23:59:00")).cast("timestamp_ntz")
    active = clicks.funnel_windows(inputs.of(sf_dir).clicks(spark).where((F.col("event_time") >= minute) & (F.col("event_time") < minute + F.expr("interval 1 minute")))).where("stage = 'any'")
    sessions = active.agg(zero(F.sum("sessions")).alias("active_sessions_last_min"))
    # The live page's ratio: purchases over the summed sessions of each minute, of the quarter of an hour that ends with this one.
    quarter = inputs.of(sf_dir).clicks(spark).where((F.col("event_time") >= minute - F.expr("interval 14 minutes")) & (F.col("event_time") < minute + F.expr("interval 1 minute")))
    stage = lambda name, value: F.sum(F.when(F.col("stage") == name, F.col(value)))
    sums = clicks.funnel_windows(quarter).agg(stage("purchase", "events").alias("_bought"), stage("any", "sessions").alias("_sessions"), stage("page_view", "events").alias("_viewed"))
    per_session = sums.select(F.when(F.col("_viewed") > 0, ratio(zero("_bought"), F.greatest("_sessions", F.lit(1)))).alias("purchases_per_session"))
    is_open = F.col("status").isin("PLACED", "PAID", "SHIPPED")
    states = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", "orders"))), ",")  # of six states at most
    board = live.status_board(spark, sf_dir).agg(zero(F.sum(F.when(is_open, F.col("orders")))).alias("open_orders"), states.alias("order_status"))
    out = summed
    for row in (items, alerts, sessions, per_session, board):  # one row each
        out = out.crossJoin(F.broadcast(row))
    return out.withColumn("avg_order_value", F.coalesce(ratio(F.col("revenue"), F.col("orders"), 2), F.lit(0.0)))


def live_funnel(spark: SparkSession, sf_dir: Source, until: str, minutes: int = 15) -> DataFrame:
    cells = clicks.funnel_windows(inputs.of(sf_dir).clicks(spark))
    return clicks.dense_series(cells, timestamp_ntz(until), bounded(minutes, 1, 360))

