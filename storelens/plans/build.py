"""Rebuilds the published tables of the warehouse."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from storelens.operators import sinks, snapshots
from storelens.plans import marts
from storelens.sources.inputs import Source

#: Dimensions first, then facts, then marts, as their readers depend on one another.
TABLES: dict[str, Callable[[SparkSession, Source], DataFrame]] = {
    "dim_customers": marts.dim_customers,
    "dim_products": marts.dim_products,
    "dim_date": marts.dim_date,
    "fct_orders": marts.fct_orders,
    "fct_order_items": lambda spark, source: marts.priced(spark, source, marts.dated_lines(spark, source, together=True)),
    "fct_sessions": marts.fct_sessions,
    "sales_daily": marts.sales_daily,
    "funnel_daily": marts.funnel_daily,
    "delivery_sla": marts.delivery_sla,
    "customer_rfm": marts.rfm,
    "abandoned_carts_daily": marts.abandoned_carts_daily,
    "dq_scorecard": marts.dq_scorecard,
}


#: Tables that are made from others of a rebuild, where these are there: which ones, and how from what reads them.
MADE_FROM: dict[str, tuple[set[str], Callable[[SparkSession, Source, Callable[[str], DataFrame]], DataFrame]]] = {
    "sales_daily": ({"fct_orders"}, lambda spark, source, there: marts.sales_of(there("fct_orders"), marts.sales_days(spark, source))),
    "customer_rfm": ({"fct_orders", "dim_customers"}, lambda spark, source, there: marts.rfm_of(there("fct_orders"), there("dim_customers"))),
    "funnel_daily": ({"fct_sessions"}, lambda spark, source, there: marts.funnel_of(there("fct_sessions"))),
}


def _made(spark: SparkSession, source: Source, name: str, there: Callable[[str], DataFrame], ready: Iterable[str]) -> DataFrame:
    """A table from those that this rebuild has made before it, or else from the inputs."""
    needed, make = MADE_FROM.get(name, (set(), None))
    return make(spark, source, there) if make and needed <= set(ready) else TABLES[name](spark, source)


def rebuild(spark: SparkSession, sf_dir: Source, warehouse: str, names: Iterable[str] = tuple(TABLES)) -> dict[str, int]:
    """Publishes the next version of each table and returns the versions; readers of a table never see half of one."""
    versions: dict[str, int] = {}
    for name in names:
        versions[name] = sinks.publish(_made(spark, sf_dir, name, lambda n: read(spark, warehouse, n), versions), f"{warehouse}/{name}")
    return versions


def commit(spark: SparkSession, source: Source, warehouse: str, names: Iterable[str] = tuple(TABLES), base: int | None = None) -> int:
    """Rebuilds tables and makes them visible in one snapshot, so that no reader sees a new fact beside an old dimension."""
    made, before = {}, set()
    for name in names:
        made[name] = lambda new, name=name, ready=frozenset(before): _made(spark, source, name, new.read, ready)
        before.add(name)
    return snapshots.commit(spark, warehouse, made, base)


def read(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """The newest whole version of a published table."""
    return sinks.current(spark, f"{warehouse}/{name}")
