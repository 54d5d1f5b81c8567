"""Published tables kept up to date by deliveries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from storelens.operators import snapshots
from storelens.operators.snapshots import Parts, Snapshot
from storelens.plans import build, marts, refresh, serve
from storelens.sources import files, inputs
from storelens.sources.inputs import Arrived


def _rows(df):
    return sorted(map(str, df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).collect()))


def test_parts_are_replaced_alone(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "day string, n int")
    snapshots.commit(spark, root, {"t": Parts(rows(("a", 1), ("b", 2), ("c", 3), (None, 4)), F.col("day")), "u": spark.range(2)})
    first = Snapshot(spark, root)
    snapshots.commit(spark, root, {"t": Parts(rows(("b", 20)), F.col("day"), ["b", "c"])})
    second = Snapshot(spark, root)
    assert first.parts("t") == ["a", "b", "c", "none"] and second.parts("t") == ["a", "b", "none"]
    assert {p: first.tables["t"]["parts"][p] == second.tables["t"]["parts"][p] for p in second.parts("t")} == {"a": True, "b": False, "none": True}
    assert sorted(r.n for r in second.read("t").collect()) == [1, 4, 20]
    assert [r.n for r in second.read("t", ["b"]).collect()] == [20] and second.read("t", []).columns == ["day", "n"]
    assert sorted(r.n for r in first.read("t").collect()) == [1, 2, 3, 4] and second.read("u").count() == 2
    with pytest.raises(ValueError, match="outside"):
        snapshots.commit(spark, root, {"t": Parts(rows(("z", 1)), F.col("day"), ["a"])})
    for n in range(3):  # older snapshots go, and with them the parts that only they name
        snapshots.commit(spark, root, {"t": Parts(rows(("b", n)), F.col("day"), ["b"])})
    assert sorted(r.n for r in Snapshot(spark, root).read("t").collect()) == [1, 2, 4]
    assert len(files.names(spark, f"{root}/t")) == 3  # the first run, which a and none are in, and those of two snapshots
    snapshots.commit(spark, root, {"t": Parts(rows(), F.col("day"))})
    assert Snapshot(spark, root).read("t").count() == 0


class _Orders(Arrived):
    """Inputs whose order log is cut by a condition of its own."""

    def __init__(self, sf_dir, orders, rest):
        super().__init__(sf_dir, F.lit(rest), F.lit(rest))
        self.orders = orders

    def order_changes(self, spark):
        return self.other.order_changes(spark).where(self.orders)


@pytest.fixture(scope="module")
def held_back(spark, sf_dir):
    """Inputs without what happened last to some orders, and that alone."""
    log = marts.inputs.of(sf_dir).order_changes(spark)
    last = log.where("op = 'u'").agg(F.max("ts_ms")).first()[0]
    late = F.col("ts_ms") == last
    return _Orders(sf_dir, ~late, True), _Orders(sf_dir, late, False)


TABLES = ("dim_customers", "fct_orders", "fct_order_items", "customer_orders", "sales_daily")


def test_a_small_delivery_rewrites_only_its_days(spark, sf_dir, held_back, tmp_path):
    before, delivered = held_back
    root = f"file://{tmp_path}"
    refresh.build(spark, before, root, TABLES)
    old = Snapshot(spark, root)
    refresh.refresh(spark, sf_dir, delivered, root, TABLES)
    new = Snapshot(spark, root)
    ids = delivered.order_changes(spark).select("order_id").distinct()
    days = {str(r[0]) for r in marts.order_core(spark, sf_dir).join(ids, "order_id").select("order_date").distinct().collect()}
    written = {t: {p for p in new.parts(t) if old.tables[t]["parts"].get(p) != new.tables[t]["parts"][p]} for t in TABLES}
    assert 1 <= len(days) < len(old.parts("fct_orders")) / 10
    assert written["fct_orders"] == days and written["fct_order_items"] <= days and not written["dim_customers"]
    assert written["sales_daily"] == {day[:7] for day in days}
    for name in TABLES:
        assert _rows(new.read(name)) == _rows(refresh.MAKERS[name](spark, sf_dir))
    refresh.refresh(spark, sf_dir, delivered, root, TABLES)  # the delivery comes again
    assert _rows(Snapshot(spark, root).read("fct_orders")) == _rows(new.read("fct_orders"))


def test_a_crash_leaves_the_old_snapshot_and_a_repetition_repairs(spark, sf_dir, held_back, tmp_path, monkeypatch):
    before, delivered = held_back
    root = f"file://{tmp_path}"
    refresh.build(spark, before, root, ["sales_daily"], by="month")
    old = _rows(Snapshot(spark, root).read("sales_daily"))
    with monkeypatch.context() as broken:
        broken.setattr(snapshots.files, "create", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            refresh.refresh(spark, sf_dir, delivered, root, ["sales_daily"])
    assert Snapshot(spark, root).number == 1 and _rows(Snapshot(spark, root).read("sales_daily")) == old
    assert files.names(spark, f"{root}/_work") == []
    assert refresh.refresh(spark, sf_dir, delivered, root, ["sales_daily"]) == 2
    assert _rows(Snapshot(spark, root).read("sales_daily")) == _rows(marts.sales_daily(spark, sf_dir))


def test_a_delivery_of_nothing_changes_nothing(spark, sf_dir, tmp_path):
    root = f"file://{tmp_path}"
    refresh.build(spark, sf_dir, root, ["fct_orders"], by="month")
    old = Snapshot(spark, root)
    refresh.refresh(spark, sf_dir, Arrived(sf_dir, F.lit(False), F.lit(False)), root, ["fct_orders"])
    assert Snapshot(spark, root).tables == old.tables


def test_a_read_by_key_opens_one_bucket(spark, sf_dir, tmp_path):
    root = f"file://{tmp_path}"
    refresh.build(spark, sf_dir, root, ["dim_customers", "dim_products"])
    old = Snapshot(spark, root)
    for name, key in (("dim_customers", 42), ("dim_products", 42), ("dim_customers", -1)):
        rows = refresh.of_key(old, name, key)
        assert len({path.split("/")[-2] for path in rows.inputFiles()}) <= 1 < len(old.parts(name))
        whole = old.read(name).where(F.col(refresh.SORTED[name]) == key)
        assert _rows(rows) == _rows(whole) and (rows.count() > 0) == (key > 0)
    assert serve.published_history(old, -1).count() == 0
    assert _rows(serve.published_prices(old, 42)) == _rows(serve.price_history(spark, sf_dir, 42))


def test_a_large_delivery_has_tables_made_anew_with_the_same_rows(spark, sf_dir, tmp_path, monkeypatch):
    """Every fortieth change touches most products; the logs are then not cut to them, and the old rows are not read."""
    late, billed = (F.pmod(F.xxhash64(*c), F.lit(40)) == 0 for c in (("ts_ms", "kafka_offset"), ("waybill",)))
    names, found = ("dim_products",), {}
    for from_ in (8, 0):  # 0: never
        monkeypatch.setattr(refresh, "REBUILT_FROM", from_)
        root, cuts = f"file://{tmp_path}/{from_}", []
        refresh.build(spark, Arrived(sf_dir, ~late, ~billed), root, names, by="month")
        monkeypatch.setattr(refresh, "Only", lambda *a, **b: cuts.append(b) or inputs.Only(*a, **b))
        refresh.refresh(spark, sf_dir, Arrived(sf_dir, late, billed), root, names)
        assert len(cuts) == (0 if from_ else 1)
        found[from_] = {name: _rows(Snapshot(spark, root).read(name)) for name in names}
    assert found[8] == found[0]


def test_tables_made_from_facts_do_not_read_the_logs_again(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setitem(build.TABLES, "sales_daily", lambda *a: pytest.fail("computed from the logs"))
    root = f"file://{tmp_path}"
    build.commit(spark, sf_dir, root, ("fct_orders", "sales_daily"))
    assert _rows(Snapshot(spark, root).read("sales_daily")) == _rows(marts.sales_daily(spark, sf_dir))


def test_facts_made_anew_move_an_order_once_and_no_keys(spark, sf_dir, tmp_path):
    """Raw orders and lines move to their order, not each change; surrogate keys are made behind the last move."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, key, most in (("fct_orders", "customer_sk", 10), ("fct_order_items", "product_sk", 6)):
            table = refresh._anew(spark, inputs.of(sf_dir), name, refresh.layout("month")[name])
            assert key not in table.rows.columns and key in table.columns and key in table.derived
            plan = table.rows._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == most
            root = f"file://{tmp_path}/{name}"
            snapshots.commit(spark, root, {name: table})
            made, whole = Snapshot(spark, root).read(name), refresh.MAKERS[name](spark, sf_dir)
            assert made.columns == whole.columns and _rows(made) == _rows(whole)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffle_files_end_with_the_writes_of_a_commit(spark, sf_dir, tmp_path):
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option, "false")
    left = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().length()
    there = left()
    refresh.build(spark, sf_dir, f"file://{tmp_path}", ["dim_customers"], by="month")
    assert left() <= there and spark.conf.get(option) == before
