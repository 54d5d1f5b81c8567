"""Cart folding, and the streaming queries over generated clicks, delivered bit by bit, against their batch twins."""

from __future__ import annotations

import datetime as dt
import json
import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors.exceptions.base import StreamingQueryException
from pyspark.sql import functions as F

from storelens.operators import cdc, clicks
from storelens.streaming import cart_state, jobs, sources, views
from storelens.streaming.folders import BatchFolders


def add(ms, product=1, quantity=1, price=10.0, **more):
    return {"event_type": "add_to_cart", "event_time_ms": ms, "product_id": product, "quantity": quantity, "price": price, **more}


def test_adds_sum_and_take_the_last_price():
    assert cart_state.fold([add(1, quantity=2), add(5, price=12.0, customer_id=7)]).value() == (36.0, 3)


def test_late_add_does_not_revive_a_bought_cart():
    assert cart_state.fold([add(1), {"event_type": "purchase", "event_time_ms": 5}, add(3)]).value() == (0, 0)


def test_late_add_before_a_removal_stays_removed():
    removed = {"event_type": "remove_from_cart", "event_time_ms": 10, "product_id": 1}
    assert cart_state.fold([removed, add(4)]).value() == (0, 0)
    assert cart_state.fold([removed, add(14)]).value() == (10.0, 1)


def test_customer_appears_at_login():
    cart = cart_state.fold([add(1), {"event_type": "page_view", "event_time_ms": 9, "customer_id": 3}])
    assert (cart.customer_id, cart.last_ms) == (3, 9)


def test_timer_never_lies_before_the_watermark():
    assert cart_state.timer_at(0, 0) == 300_000
    assert cart_state.timer_at(0, 900_000) == 900_001


@given(st.permutations([add(1), add(2, 2), add(3, quantity=4), {"event_type": "remove_from_cart", "event_time_ms": 2, "product_id": 1}]))
def test_order_of_arrival_does_not_matter(events):
    assert cart_state.fold(events).value() == (50.0, 5)


SHOP_OPENS = dt.datetime(2023, 11, 3, 6, 0)
SLOT_MINUTES = 15
KINDS = ("page_view", "product_view", "add_to_cart", "add_to_cart", "add_to_cart", "remove_from_cart", "begin_checkout", "purchase")


def random_clicks(seed: int, sessions: int = 60) -> list[dict]:
    """Sessions of some minutes over an hour, no two events of one in one instant; prices are multiples of a quarter."""
    rng, rows = random.Random(seed), []
    for number in range(sessions):
        second = rng.uniform(0, 3600)
        visitor = rng.choice((None, 500 + number))
        for _ in range(rng.randint(1, 9)):
            second += rng.uniform(1, 200)
            kind = rng.choice(KINDS)
            row = {"event_id": f"{number}-{second:.3f}", "event_type": kind, "session_id": f"visit-{number}", "customer_id": visitor, "device": "tablet", "traffic_source": "referral", "event_time": at(second)}
            if kind in ("add_to_cart", "remove_from_cart"):
                row |= {"product_id": rng.randint(1, 4), "quantity": rng.choice((None, 1, 2, 5)), "price": rng.randint(4, 400) / 4}
            rows.append(row)
    return rows


def at(second: float) -> str:
    return (SHOP_OPENS + dt.timedelta(seconds=second)).isoformat(timespec="milliseconds") + "Z"


def slots(rows: list[dict], held_back: float = 0.0, seed: int = 0) -> list[list[dict]]:
    """Deliveries of SLOT_MINUTES each, unordered inside; a share of the rows comes one delivery after its own."""
    rng = random.Random(seed)
    out: list[list[dict]] = [[] for _ in range(8)]
    for row in rows:
        slot = int((dt.datetime.fromisoformat(row["event_time"].removesuffix("Z")) - SHOP_OPENS).total_seconds() // (60 * SLOT_MINUTES))
        out[slot + (rng.random() < held_back)].append(row)
    for delivery in out:
        rng.shuffle(delivery)
    return [delivery for delivery in out if delivery]


#: Far ahead of everything, so that all timers fire.
CLOSING = {"event_id": "closing", "event_type": "page_view", "session_id": "closing", "event_time": at(200_000)}


class Deliveries:
    """A folder of message files on which a streaming query is started again after every delivery."""

    def __init__(self, spark, root, query, **options):
        self.spark, self.root, self.query, self.options, self.n = spark, root, query, options, 0
        (root / "messages").mkdir()

    def __call__(self, *deliveries: list[dict], junk: str = "") -> str:
        for rows in deliveries:
            (self.root / "messages" / f"{self.n}.txt").write_text("".join(json.dumps(r) + "\n" for r in rows) + junk)
            self.n += 1
            stream = sources.folder(self.spark, str(self.root / "messages"))
            self.query(stream, str(self.root / "out"), str(self.root / "state"), every=None, **self.options).awaitTermination()
        return str(self.root / "out")


def parsed(spark, rows):
    return clicks.parse_messages(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_carts_equal_the_batch_twin(spark, tmp_path, seed):
    rows = random_clicks(seed)
    out = Deliveries(spark, tmp_path, jobs.carts_query, fold_every=2)(*slots(rows), [CLOSING])
    columns = ["session_id", "customer_id", "cart_value", "items", F.col("last_activity_at").cast("timestamp_ntz")]
    streamed = {tuple(r) for r in jobs.cart_alerts(spark, out).select(*columns).collect()}
    batch = {tuple(r) for r in clicks.abandoned_carts(parsed(spark, rows)).select(*columns).collect()}
    assert streamed == batch and len(batch) > 10


def test_a_session_that_returns_after_its_timer_has_a_new_cart(spark, tmp_path):
    add = lambda second, product: {"event_id": f"r{second}", "event_type": "add_to_cart", "session_id": "returning", "event_time": at(second), "product_id": product, "quantity": 2, "price": 8.5}
    wake = {"event_id": "w", "event_type": "page_view", "session_id": "other", "event_time": at(1200)}
    out = Deliveries(spark, tmp_path, jobs.carts_query)([add(0, 1)], [wake], [add(1230, 3), add(1231, 4)], [CLOSING])
    assert sorted((r.session_id, r.cart_value, r["items"]) for r in jobs.cart_alerts(spark, out).collect()) == [("returning", 17.0, 2), ("returning", 34.0, 4)]


def test_a_bought_cart_stays_bought_over_deliveries(spark, tmp_path):
    event = lambda second, kind, **more: {"event_id": f"b{second}", "event_type": kind, "session_id": "buyer", "event_time": at(second)} | more
    out = Deliveries(spark, tmp_path, jobs.carts_query)([event(0, "add_to_cart", product_id=9, quantity=1, price=3.0), event(30, "purchase", order_id=4)], [event(20, "add_to_cart", product_id=8, quantity=1, price=3.0)], [CLOSING])
    assert jobs.cart_alerts(spark, out).count() == 0


def test_cells_count_what_the_watermark_lets_in(spark, tmp_path):
    """Some rows come a delivery late: those behind the watermark count for nothing."""
    rows = random_clicks(3)
    deliveries = slots(rows, held_back=0.2, seed=5)
    out = Deliveries(spark, tmp_path, jobs.funnel_query, hours=None, fold_every=3)(*deliveries)
    want, newest, dropped = Counter(), None, 0
    for delivery in deliveries:
        times = [dt.datetime.fromisoformat(r["event_time"].removesuffix("Z")) for r in delivery]
        for row, time in zip(delivery, times, strict=True):
            minute = time.replace(second=0, microsecond=0)
            if newest is None or minute + dt.timedelta(minutes=1) > newest - dt.timedelta(minutes=2):
                want.update([(minute, row["event_type"]), (minute, "any")])
            else:
                dropped += 1
        newest = max([*times, newest] if newest else times)
    got = {(r.window_start, r.stage): r.events for r in jobs.funnel_cells(spark, out).collect()}
    assert got == dict(want) and dropped > 5


def test_old_cells_go_when_batches_are_folded(spark, tmp_path):
    rows = [[{"event_id": f"h{hour}", "event_type": "purchase", "session_id": f"s{hour}", "event_time": at(3600 * hour)}] for hour in range(10)]
    out = Deliveries(spark, tmp_path, jobs.funnel_query, hours=6, fold_every=4)(*rows)
    cells = {r.window_start for r in jobs.funnel_cells(spark, out).collect()}
    assert SHOP_OPENS + dt.timedelta(hours=9) in cells and SHOP_OPENS not in cells
    assert len(list((tmp_path / "out").iterdir())) <= 4


def test_bronze_lands_every_sound_row_once(spark, tmp_path):
    rows = random_clicks(4, 20)
    deliver = Deliveries(spark, tmp_path, jobs.bronze_query)
    out = deliver(*slots(rows, held_back=0.3), junk='[1, 2]\n{"session_id": "no id"}\n\n')
    deliver([])  # nothing new
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == sorted(r["event_id"] for r in rows)


def change(n: int, table: str, op: str) -> dict:
    image = {"order_id": n}
    return {"before": None if op == "c" else image, "after": None if op == "d" else image, "op": op, "source": {"table": table, "ts_ms": 1000 + n}}


def test_changes_land_once_and_are_counted(spark, tmp_path):
    first = [change(n, "orders" if n % 3 else "customers", "cud"[n % 3]) for n in range(12)]
    out = Deliveries(spark, tmp_path, jobs.cdc_query, fold_every=2)(first[:5], first[3:9], first[9:])
    landed = jobs.new_changes(spark, out)
    assert Counter((r.table_name, r.op) for r in landed.collect()) == Counter(("orders" if n % 3 else "customers", "cud"[n % 3]) for n in range(12))
    assert sum(r.changes for r in jobs.change_counts(spark, out).collect()) == 14  # two came twice
    guards = landed.where("ts_ms < 1006").withColumn("seen_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert jobs.new_changes(spark, out, guards).count() == 6
    assert jobs.new_changes(spark, out, guards, since=F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")).count() == 12


def test_folders_are_whole_at_every_moment(spark, tmp_path):
    folders = BatchFolders(spark, str(tmp_path / "t"), fold_every=3)
    total = 0
    for batch in range(8):
        folders.write(spark.range(batch + 1), batch)
        folders.write(spark.range(batch + 1), batch)  # a repetition
        total += batch + 1
        assert folders.read().count() == total
    assert len(list((tmp_path / "t").iterdir())) <= 3
    (tmp_path / "t" / "upto=99").mkdir()  # a fold that a crash left unfinished
    assert folders.read().count() == total


def test_a_failing_query_ends_the_job(spark, tmp_path):
    def fail(batch, batch_id):
        raise RuntimeError("no disk")

    spark.streams.resetTerminated()
    spark.readStream.format("rate").load().writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "c")).start()
    with pytest.raises(StreamingQueryException, match="no disk"):
        jobs.run_until_any_fails(spark)


# Live views


def order_message(offset, order, status, before=None, op="u", ts=0, total="10.00", partition=0, at=0):
    image = lambda s: {"order_id": order, "customer_id": 1, "status": s, "order_total": total, "ship_province": "Limpopo", "payment_method": "EFT", "placed_at": "2024-01-01 00:00:00"}
    value = {"before": image(before) if before else None, "after": image(status) if op != "d" else None, "op": op, "source": {"table": "orders", "ts_ms": ts}}
    return ("shop.orders", partition, offset, dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=at), json.dumps(value))


def land(spark, root, messages):
    spark.createDataFrame(messages, sources.LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")


def live(spark, root, **more):
    jobs.live_query(sources.log_folder(spark, f"{root}/log"), f"{root}/views", f"{root}/state", every=None, **more).awaitTermination()


def board(spark, root):
    return {r["status"]: r["orders"] for r in views.read(spark, f"{root}/views", "status_board").collect() if r["orders"]}


def test_views_follow_the_stream_and_drop_what_comes_again(spark, tmp_path):
    root, names = f"file://{tmp_path}", ("status_board", "day_kpis", "recent_orders")
    first = [order_message(0, 1, "PLACED", op="c", ts=1000), order_message(1, 2, "PLACED", op="c", ts=2000), order_message(0, 3, "PLACED", op="r", ts=0, partition=1)]
    land(spark, root, first)
    live(spark, root, names=names)
    assert board(spark, root) == {"PLACED": 3}
    land(spark, root, [first[0], first[1], order_message(2, 1, "CANCELLED", "PLACED", ts=3000), order_message(2, 1, "CANCELLED", "PLACED", ts=3000), order_message(3, 2, "PAID", "PLACED", ts=4000), order_message(4, 2, "PAID", "PAID", ts=4500)])
    live(spark, root, names=names)
    land(spark, root, [first[2], order_message(5, 2, "PAID", "PAID", op="d", ts=5000)])
    live(spark, root, names=names)
    assert board(spark, root) == {"PLACED": 1, "CANCELLED": 1}
    (day,) = views.read(spark, f"{root}/views", "day_kpis").collect()
    assert (day["orders"], float(day["revenue"]), day["cancelled"]) == (2, 20.0, 1)
    assert [r["order_id"] for r in views.read(spark, f"{root}/views", "recent_orders").orderBy(F.desc("ts_ms")).collect()] == [2, 1]


def test_a_batch_that_is_repeated_adds_nothing(spark, tmp_path):
    view = views.KeyedView(spark, f"file://{tmp_path}", views.VIEWS["status_board"], buckets=4)
    batch = lambda *m: cdc.typed(cdc.parse_envelopes(spark.createDataFrame(list(m), sources.LOG)), "orders")
    found = lambda: {r["status"]: r["orders"] for r in view.read().collect()}
    view.apply(batch(order_message(0, 1, "PLACED", op="c"), order_message(1, 2, "PLACED", op="c")), 0)
    view.apply(batch(order_message(0, 1, "PLACED", op="c")), 0)
    assert found() == {"PLACED": 2}
    second = batch(order_message(2, 1, "PAID", "PLACED"))
    view.apply(second, 1)
    assert found() == {"PLACED": 1, "PAID": 1}
    (tmp_path / "batch=1" / "_SUCCESS").unlink()  # as a crash before the end leaves it
    assert found() == {"PLACED": 2}
    view.apply(second, 1)
    assert found() == {"PLACED": 1, "PAID": 1}
    for n in range(2, 9):
        view.apply(batch(order_message(n, n, "PLACED", op="c")), n)
    assert found() == {"PLACED": 8, "PAID": 1}
    folders = [p for p in tmp_path.glob("batch=*/bucket=*")]
    assert len(folders) <= 2 * len({p.name for p in folders}) and len(list(tmp_path.glob("batch=*"))) <= 4


def test_days_expire_when_their_bucket_is_written(spark, tmp_path):
    view = views.KeyedView(spark, f"file://{tmp_path}", views.VIEWS["day_kpis"], buckets=1, keep_days=3)
    batch = lambda *m: cdc.typed(cdc.parse_envelopes(spark.createDataFrame(list(m), sources.LOG)), "orders")
    day = 24 * 3600 * 1000
    view.apply(batch(*(order_message(n, n, "PLACED", op="c", ts=n * day) for n in range(3))), 0)
    view.apply(batch(order_message(3, 3, "PLACED", op="c", ts=4 * day)), 1)
    assert sorted(str(r["day"]) for r in view.read().collect()) == ["1970-01-03", "1970-01-05"]


def test_remembered_places_are_bounded_by_time(spark, tmp_path):
    """A repeat within seven days is dropped, and places older than twice that are forgotten."""
    root = f"file://{tmp_path}"
    rows = []
    for n in range(8):  # a message every fourth day, and the one before again
        land(spark, root, [order_message(n, n, "PLACED", op="c", at=4 * n), order_message(max(n - 1, 0), max(n - 1, 0), "PLACED", op="c", at=4 * n)])
        query = jobs.live_query(sources.log_folder(spark, f"{root}/log"), f"{root}/views", f"{root}/state", every=None, names=["status_board"], at="timestamp")
        query.awaitTermination()
        rows.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert board(spark, root) == {"PLACED": 8} and max(rows) <= 5


def test_messages_without_a_place_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}"
    land(spark, root, [(*order_message(0, 1, "PLACED", op="c")[:2], None, *order_message(0, 1, "PLACED", op="c")[3:])])
    with pytest.raises(StreamingQueryException, match="without kafka_offset"):
        live(spark, root, names=["status_board"])
