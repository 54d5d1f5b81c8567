"""Small cases of quality rules, sinks, versions, tiles and sources."""

from __future__ import annotations

import datetime as dt
import http.server
import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from storelens.functions import scalars
from storelens.operators import cdc, clicks, quality, ranking, sinks, snapshots
from storelens.plans import serve
from storelens.session import shared_folder
from storelens.sources import files, holidays, tables


def deliveries(spark, *rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in (*quality.DELIVERY_COLUMNS, "place")))


GOOD = ("W1", "1", "A", " Gauteng ", "2024-01-01 10:00:00", "2024-01-02 10:00:00", "delivered", "1", "1")


def test_rows_are_repaired(spark):
    r = quality.standardise(deliveries(spark, GOOD[:4] + ("02/01/2024 10:30",) + GOOD[5:])).first()
    assert (r.status, r.province, r.order_id, r.collected_at) == ("DELIVERED", "Gauteng", 1, dt.datetime(2024, 1, 2, 8, 30))


def test_bad_rows_are_rejected_with_reasons(spark):
    bad = deliveries(spark, GOOD, ("W2", "", "A", "x", "soon", "", "LOST", "9", "2"), ("W3", "3", "A", "x", "2024-01-05 00:00:00", "2024-01-01 00:00:00", "DELIVERED", None, "3"))
    good, rejected = quality.split(quality.standardise(bad), quality.delivery_rules(), ["waybill", "status"], ["place"])
    assert [r.waybill for r in good.collect()] == ["W1"]
    assert {r.waybill: r.failed_rules for r in rejected.collect()} == {
        "W2": "order_id_present,status_known,collected_at_valid,attempts_in_range",
        "W3": "delivered_after_collected,attempts_in_range",
    }


def test_repeats_are_counted(spark):
    rows = quality.standardise(deliveries(spark, GOOD, GOOD[:-1] + ("2",)))
    found = {r.rule: (r.checked, r.failed) for r in quality.rule_results(rows, quality.delivery_rules(), ["waybill", "status"]).collect()}
    assert found["unique_waybill_status"] == (2, 1) and found["order_id_present"] == (2, 0)
    assert quality.split(rows, quality.delivery_rules(), ["waybill", "status"], ["place"])[0].count() == 1


def test_upserts_and_ledger(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    assert sinks.upsert(rows, path, ["k"], ["v"]) == 2
    assert sinks.upsert(rows, path, ["k"], ["v"]) == 0
    assert sinks.upsert(spark.createDataFrame([(2, "z"), (3, "y")], "k long, v string"), path, ["k"], ["v"], update=True) == 2
    assert {r.k: r.v for r in sinks.keyed(spark, path).collect()} == {1: "a", 2: "z", 3: "y"}
    good, bad = rows.limit(2), rows.limit(1)
    assert sinks.ingest_file(good, bad, "f.csv", str(tmp_path / "w"), ["k"], ["v"]) == 2
    assert sinks.ingest_file(good, bad, "f.csv", str(tmp_path / "w"), ["k"], ["v"]) == 0


def data_files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_an_update_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    path = tmp_path / "t"
    sinks.upsert(spark.range(1000).selectExpr("id as k", "'old' as v"), str(path), ["k"], ["v"])
    before = data_files(path)
    assert sinks.upsert(spark.sql("select 7L as k, 'new' as v"), str(path), ["k"], ["v"], update=True) == 1
    after = data_files(path)
    gone, new = set(before) - set(after), set(after) - set(before)
    assert len(before) >= 60 and len({f.split("/")[0] for f in gone | new}) == 1 and len(gone) == 1
    assert all(after[f] == before[f] for f in set(before) & set(after))
    rows = sinks.keyed(spark, str(path))
    assert rows.count() == 1000 and rows.where("v = 'new'").count() == 1


def test_a_replaced_day_leaves_the_others_alone(spark, tmp_path):
    path = tmp_path / "days"
    rows = lambda *d: spark.createDataFrame([(i, dt.date(2024, 3, x)) for i, x in enumerate(d)], "i int, day date")
    sinks.overwrite_partitions(rows(*range(1, 21)), str(path), "day", "2024-03-01", "2024-03-31")
    before = data_files(path)
    sinks.overwrite_partitions(rows(5, 5), str(path), "day", "2024-03-05", "2024-03-06")
    after = data_files(path)
    assert {f for f in before if f not in after} == {f for f in before if "03-05" in f or "03-06" in f}
    assert spark.read.parquet(str(path)).count() == 20
    with pytest.raises(Exception, match="outside"):
        sinks.overwrite_partitions(rows(9), str(path), "day", "2024-03-05", "2024-03-06")


def test_readers_of_a_published_table_see_whole_versions(spark, tmp_path):
    path = tmp_path / "mart"
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, str(path))
    for n in (1, 2, 3):
        assert sinks.publish(spark.range(n), str(path)) == n
    assert sinks.current(spark, str(path)).count() == 3 and sorted(d.name for d in path.iterdir()) == ["v=2", "v=3"]
    (path / "v=4").mkdir()  # a crash before the success mark
    assert sinks.current(spark, str(path)).count() == 3 and sinks.publish(spark.range(9), str(path)) == 4


def test_an_inbox_is_loaded_once_and_emptied(spark, tmp_path):
    for folder in ("in", "archive"):
        (tmp_path / folder).mkdir()
    head, row = ",".join(quality.DELIVERY_COLUMNS), "W1,1,A,Gauteng,2024-01-01 10:00:00,2024-01-02 10:00:00,delivered,1"
    (tmp_path / "in" / "a.csv").write_text(f"{head}\n{row}\n{row.replace('W1', 'W2').replace(',1,A', ',,A')}\n")
    (tmp_path / "in" / "b.csv").write_text(f"{head}\n{row}\n{row.replace('W1', 'W3')}\n")
    (tmp_path / "in" / ".c.csv").write_text("being written")
    paths = [str(tmp_path / p) for p in ("in", "archive", "tables")]
    now = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    assert sinks.ingest_inbox(spark, *paths, now) == {"a.csv": 1, "b.csv": 1}
    assert sorted(f.name for f in (tmp_path / "in").iterdir() if f.suffix == ".csv" and not f.name.endswith(".crc")) == [".c.csv"]
    (tmp_path / "archive" / "b.csv").rename(tmp_path / "in" / "b.csv")  # crashed before the move
    assert sinks.ingest_inbox(spark, *paths, now) == {} and (tmp_path / "archive" / "b.csv").exists()
    assert {r.waybill for r in sinks.keyed(spark, f"{paths[2]}/deliveries").collect()} == {"W1", "W3"}
    [bad] = spark.read.option("header", True).csv(f"{paths[2]}/quarantine/file=a.csv").collect()
    assert (bad.waybill, bad.failed_rules, bad.source_file) == ("W2", "order_id_present", "a.csv")
    runs = spark.read.parquet(f"{paths[2]}/dq_results")
    assert runs.groupBy("run_id").count().count() == 2 and runs.where("failed_rows > 0").count() == 1


def test_not_a_number_is_a_blank(spark):
    r = quality.standardise(deliveries(spark, ("W1", "NaN", "A", "nan", "", "NaN", "delivered", "NaN", "1"))).first()
    assert (r.order_id, r.province, r.delivered_raw, r.attempts) == (None, "", "", None)


def test_overwrite_empties_days_that_lost_their_rows(spark, tmp_path):
    path = str(tmp_path / "days")
    days = lambda *d: spark.createDataFrame([(i, dt.date(2024, 1, x)) for i, x in enumerate(d)], "i int, day date")
    sinks.overwrite_partitions(days(1, 2, 3), path, "day", "2024-01-01", "2024-01-31")
    sinks.overwrite_partitions(days(3), path, "day", "2024-01-02", "2024-01-03")
    assert sorted(r.day.day for r in spark.read.parquet(path).collect()) == [1, 3]


def test_versions_and_as_of(spark):
    log = cdc.changes(spark.createDataFrame([("c", 1000, 1, 5, "a"), ("u", 3000, 2, 5, "b"), ("u", 3000, 3, 5, "c"), ("d", 9000, 4, 5, "c")], "op string, ts_ms long, kafka_offset long, k long, v string"))
    v = cdc.versions(log, "k")
    assert [(r.version, r.is_current) for r in v.orderBy("version").collect()] == [(1, False), (2, False), (3, False), (4, False)]
    facts = spark.createDataFrame([(5, "1960-01-01 00:00:00"), (5, "1970-01-01 00:00:03"), (6, "1970-01-01 00:00:03")], "k long, t string").selectExpr("k", "cast(t as timestamp_ntz) t")
    assert [r.v for r in cdc.as_of(facts, v, "k", "t", ["v"]).orderBy("k", "t").collect()] == ["a", "c", None]
    assert cdc.live(log, "k").count() == 0


def test_envelopes_survive_junk(spark):
    rows = spark.createDataFrame([('{"op": "c"}', 1), ("nonsense", 2), (None, 3), ('{"op": "c", "after": null, "source": {"table": "orders", "ts_ms": "x"}}', 4)], "value string, kafka_offset long")
    assert [(r.kafka_offset, r.ts_ms, r.after_json) for r in cdc.parse_envelopes(rows).collect()] == [(4, None, None)]


def test_clicks_survive_junk(spark):
    rows = spark.createDataFrame([("{",), ('{"event_id": "1", "session_id": "s", "event_time": "never"}',), ('{"event_id": "1", "session_id": "s", "event_time": "2024-01-01T00:00:00.000Z", "price": "x"}',)], "value string")
    assert clicks.parse_messages(rows).count() == 1


@pytest.mark.parametrize("n", [3, 11, 250])
def test_tiles_equal_one_global_window(spark, n):
    rows = spark.range(n).selectExpr("id as k", "cast(id % 7 = 0 as int) m", "cast(pmod(hash(id), 50) as int) x")
    ours = {r.k: (r.a, r.b) for r in ranking.with_tiles(rows, 5, "k", a="m", b="x").collect()}
    theirs = {r.k: (r.a, r.b) for r in rows.selectExpr("k", "ntile(5) over (order by m, k) a", "ntile(5) over (order by x, k) b").collect()}
    assert ours == theirs


def test_masks(spark):
    r = spark.createDataFrame([("jane@example.com", "+27821234567", "12345")], "e string, p string, s string").select(scalars.mask_email(F.col("e")), scalars.mask_phone(F.col("p")), scalars.mask_phone(F.col("s"))).first()
    assert tuple(r) == ("j***@example.com", "+2782*****67", "*****")


def test_rounding_and_ratio(spark):
    r = spark.range(1).select(scalars.rounded(F.lit(12.25), 1), scalars.ratio(F.lit(1), F.lit(0))).first()
    assert tuple(r) == (12.3, None)


def test_holidays_fall_back_and_refuse_other_countries():
    assert holidays.parse('[{"date": "2024-01-01", "name": "New Year", "localName": "x", "countryCode": "ZA"}]') == [("2024-01-01", "New Year", "api")]
    with pytest.raises(ValueError):
        holidays.parse('[{"date": "2024-01-01", "name": "x", "countryCode": "DE"}]')

    def broken(year):
        raise OSError("no network")

    pauses = []
    assert len(holidays.collect([2024], broken, pause=pauses.append)) == 13 and pauses == [1.0, 2.0, 4.0]


def test_holidays_from_a_service():
    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            known = self.path == "/2024"
            self.send_response(200 if known else 503)
            self.end_headers()
            if known:
                self.wfile.write(b'[{"date": "2024-05-29", "localName": "Election Day"}]')

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        fetch = holidays.over_http(f"http://127.0.0.1:{server.server_port}/{{year}}")
        rows = holidays.collect([2024, 2025], fetch, pause=lambda seconds: None)
    finally:
        server.shutdown()
    assert rows[0] == ("2024-05-29", "Election Day", "api") and {r[2] for r in rows[1:]} == {"fallback"} and len(rows) > 10


def test_movable_and_observed_holidays():
    assert [holidays.easter(y).isoformat() for y in (1954, 1981, 2000, 2008, 2011, 2024, 2038)] == ["1954-04-18", "1981-04-19", "2000-04-23", "2008-03-23", "2011-04-24", "2024-03-31", "2038-04-25"]
    days = {d: n for d, n, _ in holidays.fallback(2026)}
    assert len(days) == 13 and (days["2026-04-03"], days["2026-04-06"], days["2026-08-10"]) == ("Good Friday", "Family Day", "National Women's Day (observed)")
    assert len({d for d, _, _ in holidays.fallback(2008)}) == len(holidays.fallback(2008)) == 12  # Good Friday was a fixed day, another one a Sunday


def test_missing_folder_is_empty(spark, tmp_path):
    assert tables.parquet_or_empty(spark, str(tmp_path / "none"), spark.range(1).schema).count() == 0


def test_csv_keeps_blanks(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,\n,x\n")
    got = tables.csv_strings(spark, str(tmp_path), ["a", "b"]).orderBy("a").collect()
    assert [(r.a, r.b, r.source_file) for r in got] == [("", "x", "f.csv"), ("1", "", "f.csv")]


def test_partition_filter_prunes(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.sql("select 1 i, date'2024-01-01' day union all select 2, date'2024-02-01'").write.partitionBy("day").parquet(path)
    assert [r.i for r in tables.partitioned_since(spark, path, "day", "2024-01-15").collect()] == [2]


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        serve.bounded(0, 1, 365)


def test_unknown_customer_has_no_profile(spark, sf_dir):
    assert serve.customer_profile(spark, sf_dir, -1).count() == 0


def test_stale_source(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    loaded = spark.sql("select timestamp_ntz'2024-01-01 20:00:00' t")
    assert quality.stale(loaded, "t", now, "1 hour", "6 hours").first().state == "warn"
    assert quality.stale(loaded.limit(0), "t", now, "1 hour", "6 hours").first().state == "error"


def test_live_rows_expire(spark):
    from storelens.plans import live

    view = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' t union all select timestamp_ntz'2024-01-09 00:00:00'")
    assert live.retained(view, "t", "2024-01-10 00:00:00", "day").count() == 1
    with pytest.raises(ValueError):
        serve.best_sellers(spark, "", "2024-01-01", by="name")


def test_only_a_local_session_may_leave_the_shared_folder_unset():
    def named(master, folder):
        settings = SimpleNamespace(get=lambda *_: folder)
        return SimpleNamespace(conf=settings, sparkContext=SimpleNamespace(master=master, applicationId=master, getConf=lambda: settings))

    assert shared_folder(named("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert shared_folder(named("local[2]", None)).startswith("file:///")
    with pytest.raises(ValueError):
        shared_folder(named("spark://host:7077", None))


# Versions and points in time of a key with very many rows


def _price_log(spark, n, hot=0.5, seed=3):
    """n changes over four years, a share of them of one product, some in one instant and some deletions."""
    rows = spark.range(n).select(
        F.when(F.rand(seed) < hot, 1).otherwise(F.floor(F.rand(seed + 1) * 50) + 2).cast("long").alias("product_id"),
        (F.floor(F.rand(seed + 2) * 4 * 365 * 24) * 3_600_000 + 978_307_200_000).cast("long").alias("ts_ms"), F.col("id").alias("kafka_offset"),
        F.when(F.rand(seed + 3) < 0.05, "d").otherwise("u").alias("op"), F.col("id").alias("price"),
    )
    return cdc.changes(rows)


@pytest.fixture(scope="module")
def price_log(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('log')}/prices"
    _price_log(spark, 4000).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("span", ["year", "month"])
def test_versions_by_ranges_equal_versions_by_key(spark, price_log, span):
    plain = cdc.versions(price_log, "product_id")
    divided = cdc.versions(price_log, "product_id", span=span)
    assert divided.columns == plain.columns
    assert sorted(map(tuple, divided.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("span", [None, "year", "month"])
def test_as_of_equals_the_range_join(spark, price_log, span):
    versions = cdc.versions(price_log, "product_id")
    facts = spark.range(3000).select("id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 60).cast("long").alias("product_id"), F.when(F.col("id") % 41 == 0, None).otherwise((F.lit(946_684_800_000) + (F.col("id") * 7919 % 2300) * 86_400_000)).alias("ms"))
    facts = facts.select("id", "product_id", cdc.from_millis(F.col("ms")).alias("at")).unionByName(price_log.select((F.col("kafka_offset") + 10_000).alias("id"), "product_id", F.col("changed_at").alias("at")))
    right = versions.select(F.col("product_id").alias("k"), "valid_from", "valid_to", "version", "price")
    plain = facts.join(right, (F.col("product_id") == F.col("k")) & (F.col("at") >= F.col("valid_from")) & (F.col("at") < F.col("valid_to")), "left").select("id", "product_id", "at", "version", "price")
    found = cdc.as_of(facts, versions, "product_id", "at", ["version", "price"], span=span)
    assert found.columns == plain.columns and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_one_product_with_very_many_rows_is_several_tasks(spark, tmp_path):
    """200,000 versions and as many facts of one product: rows grow with neither side's square, and no task has most of them."""
    path = f"file://{tmp_path}/log"
    _price_log(spark, 200_000, hot=1.0).write.parquet(path)
    log = spark.read.parquet(path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        versions = cdc.versions(log, "product_id", span="month")
        facts = log.select("product_id", F.col("changed_at").alias("at"))
        found = cdc.as_of(facts, versions, "product_id", "at", ["version"], span="month").select("version", F.spark_partition_id().alias("task"))
        by_task = [r["count(version)"] for r in found.groupBy("task").agg(F.count("version"), F.sum("version")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(by_task) == 200_000 and len(by_task) >= 20 and max(by_task) < 30_000


# Snapshots of several tables


def _pair(spark, n):
    return {"facts": spark.range(n), "dims": spark.range(10 * n).withColumnRenamed("id", "key")}


def _seen(spark, root):
    s = snapshots.Snapshot(spark, root)
    return s.number, s.read("facts").count(), s.read("dims").count()


def test_tables_become_visible_together(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert snapshots.commit(spark, root, _pair(spark, 1)) == 1 and _seen(spark, root) == (1, 1, 10)
    reader = snapshots.Snapshot(spark, root)
    assert snapshots.commit(spark, root, {"facts": spark.range(2)}, base=1) == 2 and _seen(spark, root) == (2, 2, 10)
    assert (reader.read("facts").count(), reader.read("dims").count()) == (1, 10)
    for n in range(3, 6):
        snapshots.commit(spark, root, _pair(spark, n))
    assert _seen(spark, root) == (5, 5, 50) and len(list(tmp_path.glob("facts/run=*"))) == 2
    with pytest.raises(FileNotFoundError):
        snapshots.Snapshot(spark, root).read("other")


@pytest.mark.parametrize("step", ["second table", "manifest", "half a manifest", "expiry"])
def test_a_crash_leaves_a_whole_snapshot(spark, tmp_path, monkeypatch, step):
    root = f"file://{tmp_path}"
    for n in (1, 2):
        snapshots.commit(spark, root, _pair(spark, n))
    tables = _pair(spark, 3)
    if step == "second table":
        tables["dims"] = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("key"))
    elif step == "manifest":
        monkeypatch.setattr(snapshots.files, "create", lambda *a: 1 / 0)
    elif step == "half a manifest":
        whole = files.create
        monkeypatch.setattr(snapshots.files, "create", lambda s, path, content: whole(s, path, content[:9]) and 1 / 0)
    else:
        monkeypatch.setattr(snapshots, "_expire", lambda *a: 1 / 0)
    with pytest.raises(Exception, match="lost|division"):
        snapshots.commit(spark, root, tables)
    monkeypatch.undo()
    assert _seen(spark, root) == ((3, 3, 30) if step == "expiry" else (2, 2, 20))
    number = snapshots.commit(spark, root, _pair(spark, 4))
    assert _seen(spark, root) == (number, 4, 40)


def test_of_two_writers_one_loses(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    snapshots.commit(spark, root, _pair(spark, 1))
    whole = files.create

    def late(s, path, content):  # the other one commits between this one's tables and its manifest
        monkeypatch.undo()
        snapshots.commit(s, root, _pair(s, 2), base=1)
        return whole(s, path, content)

    monkeypatch.setattr(snapshots.files, "create", late)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, _pair(spark, 3), base=1)
    assert _seen(spark, root) == (2, 2, 20) and len(list(tmp_path.glob("facts/run=*"))) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, _pair(spark, 4), base=1)


# Inbox


def _fill(inbox, files_, rows=3):
    inbox.mkdir(parents=True, exist_ok=True)
    for n in files_:
        lines = [",".join(quality.DELIVERY_COLUMNS)]
        lines += [f"W{n}-{i},{i + 1},A,Gauteng,2024-01-01 10:00:00,2024-01-02 10:00:00,DELIVERED,{9 if i == 2 else 1}" for i in range(rows)]
        (inbox / f"f{n:03d}.csv").write_text("\n".join([*lines, f"SHARED,7,A,Gauteng,2024-01-01 10:00:00,2024-01-02 10:00:00,DELIVERED,{n % 5}"]) + "\n")


def _ingest(spark, root, group="inbox"):
    spark.sparkContext.setJobGroup(group, group)
    try:
        loaded = sinks.ingest_inbox(spark, f"file://{root}/in", f"file://{root}/archive", f"file://{root}/tables", F.lit("2024-02-01").cast("timestamp_ntz"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return loaded, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_many_files_take_as_many_jobs_as_few(spark, tmp_path):
    _fill(tmp_path / "few" / "in", range(2))
    _fill(tmp_path / "many" / "in", range(60))
    few, jobs_of_few = _ingest(spark, tmp_path / "few", "few")
    many, jobs_of_many = _ingest(spark, tmp_path / "many", "many")
    assert few == {"f000.csv": 3, "f001.csv": 2} and sum(many.values()) == 121 and len(many) == 60
    assert jobs_of_many <= jobs_of_few + 6
    ledger = spark.read.parquet(f"file://{tmp_path}/many/tables/ledger")
    assert ledger.count() == 60 and ledger.agg(F.sum("rows_rejected")).first()[0] == 60
    [kept] = sinks.keyed(spark, f"file://{tmp_path}/many/tables/deliveries").where("waybill = 'SHARED'").collect()
    assert kept["source_file"] == "f000.csv"


@pytest.mark.parametrize("step", ["_overwrite", "upsert", "keyed"])
def test_a_pass_that_crashes_is_repeated_whole(spark, tmp_path, monkeypatch, step):
    """After a crash at a step the next pass ends as one without a crash; a further one finds nothing to do."""
    _fill(tmp_path / "in", range(3))
    right = getattr(sinks, step)

    def fails(*args, **more):
        out = right(*args, **more)
        monkeypatch.undo()
        raise RuntimeError("lost" + str(out)[:0])

    monkeypatch.setattr(sinks, step, fails)
    with pytest.raises(RuntimeError, match="lost"):
        _ingest(spark, tmp_path)
    loaded, _ = _ingest(spark, tmp_path)
    assert loaded == {"f000.csv": 3, "f001.csv": 2, "f002.csv": 2} and _ingest(spark, tmp_path)[0] == {}
    assert sinks.keyed(spark, f"file://{tmp_path}/tables/deliveries").count() == 7
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/tables/quarantine").count() == 3
    assert spark.read.parquet(f"file://{tmp_path}/tables/dq_results").count() == 3 * 9
    assert len(list((tmp_path / "archive").glob("*.csv"))) == 3
