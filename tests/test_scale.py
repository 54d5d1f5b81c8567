"""Steps that have to grow no faster than their input, on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from storelens.operators import cdc, clicks
from storelens.plans import marts
from storelens.sources import files, inputs
from storelens.streaming import cart_state, jobs, replays, sources, views
from storelens.streaming.folders import BatchFolders

EVENT = "session_id string, event_time timestamp, event_type string, customer_id long, product_id long, quantity int, price double"


@pytest.fixture
def carts(spark, tmp_path):
    kept = cart_state.OpenCarts(spark, f"file://{tmp_path}/open")

    def apply(rows: list[tuple], batch: int) -> set[tuple]:
        out: list[tuple] = []
        made = spark.createDataFrame(rows, "session_id string, ms long, event_type string, customer_id long, product_id long, quantity int, price double").withColumn("event_time", F.timestamp_millis("ms")).drop("ms")
        kept.apply(made, batch, lambda alerts: out.extend(alerts.selectExpr("session_id", "customer_id", "cart_value", "items", "unix_millis(last_activity_at)").collect()))
        return set(map(tuple, out))

    return apply


def test_open_carts_fold_as_events_do_and_a_repeated_batch_gives_the_same(carts):
    rng = random.Random(4)
    kinds = ["add_to_cart"] * 5 + ["remove_from_cart", "page_view", "product_view"]
    rows = [(f"s{rng.randrange(40)}", 1_000_000 + rng.randrange(120) * 1000, "purchase" if rng.random() < 0.02 else rng.choice(kinds), rng.choice([None, 7, 8]), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), rng.choice([None, 1.5, 20.0])) for _ in range(600)]
    want = set()
    for session in {r[0] for r in rows}:
        names = ("event_time_ms", "event_type", "customer_id", "product_id", "quantity", "price")
        cart = cart_state.fold([dict(zip(names, r[1:], strict=True)) for r in rows if r[0] == session])
        if cart.value()[1]:
            want.add((session, cart.customer_id, *cart.value(), cart.last_ms))
    wake = [("flush", 10_000_000, "page_view", None, None, None, None)]
    assert carts(rows[:300], 0) == set() and carts(rows[300:], 1) == set()
    assert carts(wake, 2) == carts(wake, 2) == want and len(want) > 10
    assert carts(wake, 3) == set()


def test_approximate_sessions_stay_within_the_tolerance_in_cells_of_all_sizes(spark):
    """Of many cells with 13 sessions each, a coarse sketch is off by two in some."""
    rows = spark.range(4000 * 13).select((F.col("id") / 13).cast("long").alias("cell"), "id").unionByName(spark.range(60_000).select(((F.col("id") / 20_000).cast("long") + 5000).alias("cell"), (F.col("id") + 1_000_000).alias("id")))
    made = rows.select(F.timestamp_seconds(F.col("cell") * 60).cast("timestamp_ntz").alias("event_time"), F.concat(F.lit("s"), "id").alias("session_id"), F.lit("page_view").alias("event_type"))
    exact, close = (clicks.funnel_windows(made, exact=e).select("window_start", "stage", F.col("sessions").alias(n)) for e, n in ((True, "sessions"), (False, "approx")))
    both = exact.join(close, ["window_start", "stage"])
    assert both.count() == 2 * 4003
    assert both.where("abs(approx - sessions) > greatest(1, 0.15 * sessions)").count() == 0


def test_messages_are_written_once_and_compressed(spark, sf_dir, tmp_path):
    class Done:
        def awaitTermination(self) -> None:
            pass

    replays._deliver(spark, sf_dir, f"file://{tmp_path}/feed", {"inventory"}, lambda messages: Done())
    landed = [p for p in (tmp_path / "feed").rglob("*.parquet") if p.is_file()]
    assert landed and all(".zstd." in p.name and "log" in p.parts for p in landed)
    assert spark.read.parquet(*{str(p.parent) for p in landed}).select("kafka_offset").distinct().count() == replays.log(spark, sf_dir, "inventory").count()


def test_messages_are_built_and_read_once(spark, sf_dir):
    """No filter builds or reads a message a second time; junk is dropped all the same."""
    from storelens.operators import cdc
    from storelens.sources import adapters

    typed = cdc.typed(cdc.parse_envelopes(cdc.to_envelopes(adapters.order_changes(spark, sf_dir), "orders")), "orders")
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1
    assert plan.count("from_json(") == 2  # the message, and the image in it
    junk = spark.createDataFrame([(None, 1), ("no json", 2), ('{"op": "c"}', 3), ('{"source": {"table": "orders"}}', 4), ('{"op": "c", "source": {"table": "orders", "ts_ms": "5"}}', 5)], "value string, kafka_offset long")
    assert [(r.table_name, r.op, r.ts_ms, r.kafka_offset) for r in cdc.parse_envelopes(junk).collect()] == [("orders", "c", 5, 5)]


def test_sales_and_dated_lines_move_once_on_their_way_to_the_facts(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {name: make(spark, sf_dir)._jdf.queryExecution().executedPlan().toString() for name, make in (("facts", marts.fct_order_items), ("products", marts.dim_products))}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Lines by key, order and product, the order log, sales, ids and names of parts; sales, ids and names of parts, stock.
    assert {name: plan.count("Exchange hashpartitioning") for name, plan in plans.items()} == {"facts": 7, "products": 4}


def test_busy_products_are_divided_with_the_same_result(spark, sf_dir, monkeypatch):
    found = {}
    for busy in (marts.BUSY, 30):
        monkeypatch.setattr(marts, "BUSY", busy)
        found[busy] = [sorted(map(str, make(spark, sf_dir).collect())) for make in (marts.dim_products, marts.fct_order_items)]
    some = inputs.of(sf_dir).busy_products(spark, 30).count()
    assert 0 < some < spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert found[30] == found[1_000_000]


def test_a_line_without_a_known_product_has_no_version(spark, sf_dir):
    lines = spark.createDataFrame([(1, None, 2), (2, -7, 3), (3, 42, 4)], "order_id long, product_id long, quantity int").selectExpr("*", "cast(10 as decimal(12,2)) as unit_price", "timestamp_ntz'1998-01-01 00:00:00' as placed_at", "true as is_revenue")
    rows = {r.order_id: r for r in marts.priced(spark, sf_dir, lines).collect()}
    assert len(rows) == 3 and rows[3].product_sk is not None and rows[3].product_name is not None
    assert all(rows[n][c] is None for n in (1, 2) for c in ("product_sk", "product_name", "category", "unit_cost_at_sale", "line_margin"))


def _plan(made) -> str:
    return made._jdf.queryExecution().executedPlan().toString()


def test_a_message_moves_as_the_columns_that_its_view_takes(spark, sf_dir, tmp_path):
    """The guard's state gets places and those columns; changes that give a view no row are not remembered."""
    root = f"file://{tmp_path}"
    log = replays.log(spark, sf_dir, "orders")
    log.write.parquet(f"{root}/log")
    query = jobs.live_query(sources.log_folder(spark, f"{root}/log"), f"{root}/views", f"{root}/state", every=None, names=["recent_orders"])
    query.awaitTermination()
    created = spark.read.parquet(f"{root}/log").where("value like '%\"op\":\"c\"%'").count()
    assert 0 < created < log.count() and query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] == created
    read = cdc.images(log, views.wanted(["status_board", "day_kpis", "product_days"]), "topic")
    assert read.columns == ["table_name", "op", "ts_ms", "kafka_offset", "topic", "image", "previous_status"]
    assert read.schema["image"].dataType.fieldNames() == ["status", "order_total", "product_id", "quantity", "unit_price"]
    assert _plan(read).count("from_json(") == 1


@pytest.mark.parametrize("table", ["orders", "order_items", "products", "customers", "inventory"])
def test_wanted_images_equal_whole_ones(spark, sf_dir, table):
    log = replays.log(spark, sf_dir, table).unionByName(spark.createDataFrame([("t", 0, 1, None, None), ("t", 0, 2, None, "no json"), ("t", 0, 3, None, '{"op": "c"}')], sources.LOG))
    names = [n for n, v in views.VIEWS.items() if v.table == table]
    columns = views.wanted(names)[table].columns
    whole, some = cdc.typed(cdc.parse_envelopes(log), table), cdc.typed_images(cdc.images(log, {table: cdc.Wanted(columns, lambda op: op.isNotNull())}), table, columns)
    assert some.count() == whole.count() > 0 and set(columns) < set(whole.columns)
    assert some.exceptAll(whole.select(some.columns)).count() == 0


def test_changes_move_once_to_become_messages(spark, sf_dir):
    """Orders move before they are divided into changes, and products before they have their names."""
    for table in ("orders", "products"):
        plan = _plan(replays.log(spark, sf_dir, table))
        assert plan.count("Exchange hashpartitioning") == 1
        above = plan[: plan.index("Exchange hashpartitioning")]
        assert ("Generate explode" if table == "orders" else "Join") in above


def test_writes_into_few_folders_sort_nothing(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = spark.range(5000).withColumn("part", F.col("id") % 3)
    folders = BatchFolders(spark, f"file://{tmp_path}/t", partition_by=("part",))
    with files.few_folders(spark):
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "16"
        rows.write.partitionBy("part").parquet(f"file://{tmp_path}/plain")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    written = folders.save(rows, 0)
    assert written.groupBy("part").count().count() == 3 and written.count() == 5000 == spark.read.parquet(f"file://{tmp_path}/plain").count()


def test_batches_without_rows_leave_nothing_to_fold(spark, tmp_path):
    folders = BatchFolders(spark, f"file://{tmp_path}/t", fold_every=2, partition_by=("part",))
    rows = spark.range(10).withColumn("part", F.lit(1))
    assert folders.save(rows, 0).count() == 10
    for batch in range(1, 5):
        assert folders.save(rows.where("id < 0"), batch) is None
        folders.fold_if_due()
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["batch=0"]
    folders.save(rows, 5)
    folders.fold_if_due()
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["upto=5"] and folders.read().count() == 20


def test_orders_made_anew_ask_for_no_changed_customers(spark, sf_dir, monkeypatch):
    from storelens import catalog
    from storelens.plans import refresh

    def asked(*_):
        raise AssertionError("customers are read for nothing")

    monkeypatch.setattr(refresh, "_since", asked)
    facts = catalog.QUERIES["refreshed_fct_orders"](spark, sf_dir)
    assert facts.count() == marts.order_core(spark, sf_dir).count() > 0


def test_a_published_version_leaves_no_shuffle_files(spark, tmp_path):
    from storelens.operators import sinks

    left = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().length()
    there = left()
    sinks.publish(spark.range(1000).groupBy(F.col("id") % 7).count(), f"file://{tmp_path}/t")
    assert left() <= there and sinks.current(spark, f"file://{tmp_path}/t").count() == 7


def test_landing_does_not_count_the_rows_of_its_state_and_drops_copies_all_the_same(spark, sf_dir, tmp_path):
    root, option = f"file://{tmp_path}", "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    before = spark.conf.get(option, "true")
    log = replays.log(spark, sf_dir, "customers")
    log.unionByName(log.where("kafka_offset % 3 = 0")).write.parquet(f"{root}/log")
    query = jobs.cdc_query(sources.log_folder(spark, f"{root}/log"), f"{root}/cdc", f"{root}/state", every=None)
    query.awaitTermination()
    assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] == 0 and spark.conf.get(option, "true") == before
    assert jobs.landed_changes(spark, f"{root}/cdc").count() == log.count() > 0
