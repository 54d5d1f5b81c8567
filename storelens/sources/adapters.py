"""The store's inputs, derived from the TPC-H-like tables by fixed rules.

Money is decimal from here on; times are zone-less and mean UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.scalars import epoch_millis
from storelens.sources.tables import table

PROVINCES = ("Gauteng", "Western Cape", "KwaZulu-Natal", "Eastern Cape", "Free State", "Limpopo", "Mpumalanga", "North West", "Northern Cape")
SOURCES = ("direct", "search", "social", "email", "ads", "referral")
DEVICES = ("mobile", "desktop", "tablet")
PAYMENTS = ("CARD", "EFT", "COD")
FEES = ("0", "50", "99")
COURIERS = ("CourierA", "CourierB", "CourierC")
#: Event types of the table and what they stand for in the store.
STAGES = {"view": "product_view", "click": "add_to_cart", "signup": "begin_checkout", "purchase": "purchase", "error": "remove_from_cart"}

MONEY = "decimal(12,2)"


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def clicks(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """Click events; with ``repeated`` every fiftieth event is delivered twice."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))[F.col("event_type")]
    kind = F.when((F.col("event_type") == "view") & (k % 2 == 0), "page_view").otherwise(kind)
    out = events.select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("event_time"),
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("user_id").alias("customer_id"),
        kind.alias("event_type"),
        pick(DEVICES, F.col("user_id")).alias("device"),
        pick(SOURCES, k).alias("traffic_source"),
        F.concat(F.lit("/p/"), k.cast("string")).alias("page"),
        k.cast("long").alias("product_id"),
        (1 + k % 3).alias("quantity"),
        F.col("value").cast(MONEY).alias("price"),
        (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("event_id") * 37 % 150).cast("decimal(18,6)"))).alias("ingested_at"),
    )
    return out.unionByName(out.where("event_id % 50 = 0")) if repeated else out


def order_changes(spark: SparkSession, sf_dir: str, together: bool = False, tasks: int | None = None) -> DataFrame:
    """The change log of orders: one row a change, with the row's image in columns.

    together: an order's changes lie in one partition; the order is moved there, and not each change.
    tasks: how many partitions they then lie in, where few tasks, as orders are small, would each have many changes.
    """
    k = F.col("o_orderkey")
    state = F.col("o_orderstatus")
    steps = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("c").alias("op"), F.lit("PLACED").alias("status"), F.lit(0).alias("day")),
        F.when(k % 17 == 0, F.struct(F.lit(1).alias("seq"), F.lit("u").alias("op"), F.lit("CANCELLED").alias("status"), F.lit(1).alias("day"))).when(
            (state != "P") | (k % 2 == 1), F.struct(F.lit(1).alias("seq"), F.lit("u").alias("op"), F.lit("PAID").alias("status"), F.lit(1).alias("day"))
        ),
        F.when((k % 17 != 0) & (state != "P"), F.struct(F.lit(2).alias("seq"), F.lit("u").alias("op"), F.lit("SHIPPED").alias("status"), F.lit(3).alias("day"))),
        F.when((k % 17 != 0) & (state == "F"), F.struct(F.lit(3).alias("seq"), F.lit("u").alias("op"), F.lit("DELIVERED").alias("status"), F.lit(7).alias("day"))),
    )
    final = F.when(k % 17 == 0, "CANCELLED").when(state == "F", "DELIVERED").when(state == "O", "SHIPPED").when(k % 2 == 1, "PAID").otherwise("PLACED")
    gone = F.when(k % 97 == 0, F.struct(F.lit(9).alias("seq"), F.lit("d").alias("op"), final.alias("status"), F.lit(30).alias("day")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    moved = orders if not together else orders.repartition("o_orderkey") if tasks is None else orders.repartition(tasks, "o_orderkey")
    log = moved.withColumn("step", F.explode(F.array_compact(F.concat(steps, F.array(gone)))))
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("step.day"))
    customer = F.col("o_custkey")
    return log.select(
        F.col("step.op").alias("op"),
        epoch_millis(at).alias("ts_ms"),
        (k * 16 + F.col("step.seq")).alias("kafka_offset"),
        k.alias("order_id"),
        customer.alias("customer_id"),
        F.when(k % 7 == 0, F.concat_ws("-", F.floor(k / 7) % 150, F.lit("202401"))).alias("_session"),
        F.col("step.status").alias("status"),
        pick(PAYMENTS, k).alias("payment_method"),
        pick(FEES, k).cast("decimal(10,2)").alias("shipping_fee"),
        F.col("o_totalprice").cast(MONEY).alias("order_total"),
        pick(PROVINCES, customer).alias("ship_province"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("placed_at"),
    ).select(
        "op", "ts_ms", "kafka_offset", "order_id", "customer_id",
        F.concat(F.col("_session"), F.lpad((F.col("order_id") % 30 + 1).cast("string"), 2, "0")).alias("session_id"),
        "status", "payment_method", "shipping_fee", "order_total", "ship_province", "placed_at",
    )


def order_item_changes(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """The change log of order lines, one line for each order and part.

    together: all lines of an order lie in one partition; they are moved there before they are changes.
    """
    sold = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.col("l_extendedprice").cast(MONEY).alias("_price"), "l_shipdate")
    lines = (sold.repartition("l_orderkey") if together else sold).groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))
    keyed = lines.agg(F.sum("l_quantity").cast("int").alias("quantity"), F.max("_price").alias("unit_price"), F.min("l_shipdate").cast("timestamp_ntz").alias("at"))
    both = F.col("order_id") + F.col("product_id")
    step = lambda op, more, hours: F.struct(F.lit(op).alias("op"), F.lit(more).alias("more"), F.lit(hours).alias("hours"))
    log = keyed.withColumn("step", F.explode(F.array_compact(F.array(step("c", 0, 0), F.when(both % 13 == 0, step("u", 1, 1)), F.when(both % 29 == 0, step("d", 1, 2))))))
    return log.select(
        F.col("step.op").alias("op"),
        epoch_millis(F.col("at") + F.make_dt_interval(hours=F.col("step.hours"))).alias("ts_ms"),
        (F.col("order_id") * 4 + F.col("step.hours")).alias("kafka_offset"),
        "order_id",
        "product_id",
        (F.col("quantity") + F.when(both % 13 == 0, F.col("step.more")).otherwise(0)).alias("quantity"),
        "unit_price",
    )


def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What never changes of a product."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"))


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of products without their names: every price at which a part was sold."""
    sold = table(spark, sf_dir, "lineitem").select(
        F.lit("u").alias("op"),
        epoch_millis(F.col("l_shipdate").cast("timestamp_ntz")).alias("ts_ms"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("kafka_offset"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity").cast("int").alias("_quantity"),
        F.col("l_suppkey").alias("_supplier"),
    )
    known = sold.join(product_names(spark, sf_dir).select("product_id"), "product_id", "left_semi")
    return known.withColumn("cost", (F.col("price") * F.lit("0.6").cast("decimal(2,1)")).cast("decimal(14,3)").cast(MONEY))


def product_changes(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """The change log of products with their names.

    together: a product's changes lie in one partition; they are moved there before they have their names.
    """
    prices = price_changes(spark, sf_dir)
    return (prices.repartition("product_id") if together else prices).join(product_names(spark, sf_dir), "product_id")


def busy_products(spark: SparkSession, sf_dir: str, more_than: int) -> DataFrame:
    """Products with more sales than so many."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_id")).count().where(F.col("count") > more_than).select("product_id")


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of customers: created, every third moved, every 101st deleted."""
    c = F.col("c_custkey")
    step = lambda seq, op, moved, day: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), moved.alias("moved"), day.cast("int").alias("day"))
    steps = F.array_compact(
        F.array(
            step(0, "c", F.lit(0), c % 1000),
            F.when(c % 3 == 0, step(1, "u", F.lit(1), 2922 + c % 365)),
            F.when(c % 101 == 0, step(2, "d", F.when(c % 3 == 0, 1).otherwise(0), F.lit(4018))),
        )
    )
    log = table(spark, sf_dir, "customer").withColumn("step", F.explode(steps))
    born = F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
    return log.select(
        F.col("step.op").alias("op"),
        epoch_millis(born + F.make_dt_interval(days=F.col("step.day"))).alias("ts_ms"),
        (c * 4 + F.col("step.seq")).alias("kafka_offset"),
        c.alias("customer_id"),
        F.col("c_name").alias("first_name"),
        F.concat(F.lit("Family"), (c % 10).cast("string")).alias("last_name"),
        F.concat(F.lit("user"), c.cast("string"), F.lit("@example.com")).alias("email"),
        F.when(c % 50 != 0, F.concat(F.lit("+27"), F.lpad(c.cast("string"), 9, "0"))).alias("phone"),
        pick(PROVINCES, c + F.col("step.moved")).alias("province"),
        F.concat(F.lit("City "), (c % 20).cast("string")).alias("city"),
        (c % 2 == 0).alias("marketing_opt_in"),
        (born + F.make_dt_interval(days=(c % 1000).cast("int"))).alias("created_at"),
    )


def inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock of every product: a snapshot, and an update for every fifth."""
    p = F.col("p_partkey")
    step = lambda op, seq: F.struct(F.lit(op).alias("op"), F.lit(seq).alias("seq"))
    log = table(spark, sf_dir, "part").withColumn("step", F.explode(F.array_compact(F.array(step("r", 0), F.when(p % 5 == 0, step("u", 1))))))
    return log.select(
        F.col("step.op").alias("op"),
        (F.lit(1_000_000_000_000) + F.col("step.seq") * 1000).alias("ts_ms"),
        (p * 2 + F.col("step.seq")).alias("kafka_offset"),
        p.alias("product_id"),
        F.when(F.col("step.seq") == 0, p * 7919 % 160).otherwise(p * 31 % 40).cast("int").alias("stock_on_hand"),
        (F.col("p_size") % 20).cast("int").alias("reorder_level"),
    )


def deliveries_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partner's delivery rows as strings, with the dirt such files have, and their place in the file."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("timestamp_ntz").alias("placed"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("k"))
    k = F.col("k")
    done = F.col("l_linestatus") == "F"
    hours = ((F.col("l_quantity").cast("long") * 7919 + F.col("l_partkey")) % 144 + 1).cast("int")
    collected = F.col("placed") + F.expr("interval 2 hours")
    delivered = F.when(k % 200 == 3, collected - F.expr("interval 5 hours")).otherwise(collected + F.make_dt_interval(hours=hours))
    status = F.when(done, "DELIVERED").otherwise("IN_TRANSIT")
    rows = joined.select(
        F.concat(F.lit("W"), k.cast("string")).alias("waybill"),
        F.when(k % 100 == 0, "").otherwise(k.cast("string")).alias("order_id"),
        pick(COURIERS, F.col("l_suppkey")).alias("courier"),
        F.concat(F.lit(" "), pick(PROVINCES, F.col("customer"))).alias("province"),
        F.when(k % 101 == 0, F.date_format(collected, "dd/MM/yyyy HH:mm")).when(k % 211 == 5, "soon").otherwise(F.date_format(collected, "yyyy-MM-dd HH:mm:ss")).alias("collected_at"),
        F.when(done, F.date_format(delivered, "yyyy-MM-dd HH:mm:ss")).otherwise("").alias("delivered_at"),
        F.when(k % 90 == 0, F.lower(status)).otherwise(status).alias("status"),
        F.when(k % 150 == 0, "9").otherwise((1 + k % 3).cast("string")).alias("attempts"),
        F.struct("k", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), F.col("l_extendedprice").cast(MONEY).alias("p"), F.col("l_shipdate").alias("s")).alias("_place"),
    )
    again = rows.where("_place.k % 100 = 7")
    return rows.withColumn("_copy", F.lit(0)).unionByName(again.withColumn("_copy", F.lit(1)))
