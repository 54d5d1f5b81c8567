"""Data-quality rules as columns, evaluated in one pass; assertions that return their violations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.scalars import partner_time, ratio

#: The delivery states a partner may report.
STATUSES = ("DELIVERED", "FAILED_ATTEMPT", "RETURNED_TO_SENDER", "IN_TRANSIT")
DELIVERY_COLUMNS = ("waybill", "order_id", "courier", "province", "collected_at", "delivered_at", "status", "attempts")


class Rule(NamedTuple):
    name: str
    dimension: str
    holds: Column


def delivery_rules() -> list[Rule]:
    """True where a standardised delivery row is sound; null counts as failed."""
    c = F.col
    return [
        Rule("order_id_present", "completeness", c("order_id").isNotNull()),
        Rule("waybill_present", "completeness", c("waybill") != ""),
        Rule("status_known", "validity", c("status").isin(*STATUSES)),
        Rule("collected_at_valid", "validity", c("collected_at").isNotNull()),
        Rule("delivered_at_valid", "validity", (c("delivered_raw") == "") | c("delivered_at").isNotNull()),
        Rule("delivered_has_timestamp", "completeness", (c("status") != "DELIVERED") | c("delivered_at").isNotNull()),
        Rule("delivered_after_collected", "consistency", c("delivered_at").isNull() | F.coalesce(c("delivered_at") >= c("collected_at"), F.lit(False))),
        Rule("attempts_in_range", "validity", c("attempts").between(0, 5)),
    ]


def _typed_delivery() -> dict[str, Column]:
    """Each column of a delivery from its trimmed string; delivered_raw keeps the string that the rules need."""
    text = {c: F.trim(F.when(F.lower(c) == "nan", F.lit("")).otherwise(F.coalesce(F.col(c), F.lit("")))) for c in DELIVERY_COLUMNS}
    numbers = {c: text[c].try_cast("long") for c in ("order_id", "attempts")}
    times = {c: partner_time(text[c]) for c in ("collected_at", "delivered_at")}
    return text | numbers | times | {"status": F.upper(text["status"]), "delivered_raw": text["delivered_at"]}


def standardise(raw: DataFrame) -> DataFrame:
    """Trims, cases and types a partner's strings; what does not parse becomes null, and NaN is a blank."""
    return raw.select(*(value.alias(name) for name, value in _typed_delivery().items()), *(c for c in raw.columns if c not in DELIVERY_COLUMNS))


def checked(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds failed_rules: the names of the rules a row breaks, joined by commas; empty for a good row."""
    names = [F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.name)) for r in rules]
    return rows.withColumn("failed_rules", F.concat_ws(",", *names))


def split(rows: DataFrame, rules: list[Rule], key: list[str], place: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows without repeats of the key, the first by place; rejected rows with reasons)."""
    marked = checked(rows, rules)
    # Good rows come first in a group and bad ones go after the numbering: a filter before it would be pushed
    # down to the source, and every rule and every parsed value in it be computed once more for each use.
    w = Window.partitionBy(*key).orderBy(F.col("failed_rules") != "", *place)
    good = marked.withColumn("_n", F.row_number().over(w)).where("_n = 1 and failed_rules = ''").drop("_n", "failed_rules")
    return good, marked.where("failed_rules <> ''")


def rule_results(rows: DataFrame, rules: list[Rule], key: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., rule, dimension, checked, failed): one pass over the rows, then turned into one row a rule."""
    marked = checked(rows, rules)
    good = F.col("failed_rules") == ""
    counts = [F.count_if(~F.coalesce(r.holds, F.lit(False))).alias(f"f{i}") for i, r in enumerate(rules)]
    summed = marked.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_distinct(F.when(good, F.struct(*key))).alias("keys"), *counts)
    one = lambda name, dimension, n, failed: F.struct(F.lit(name).alias("rule"), F.lit(dimension).alias("dimension"), n.alias("checked"), failed.alias("failed"))
    results = [one(r.name, r.dimension, F.col("n"), F.col(f"f{i}")) for i, r in enumerate(rules)]
    results.append(one("unique_waybill_status", "uniqueness", F.col("good"), F.col("good") - F.col("keys")))
    return summed.select(*(by or []), F.explode(F.array(*results)).alias("r")).select(*(by or []), "r.*")


def scorecard(results: DataFrame, since: Column) -> DataFrame:
    """Pass rate of each data set's rules over the runs since a time."""
    recent = results.where(F.col("run_at") >= since)
    summed = recent.groupBy("dataset", "rule_name", "dimension").agg(F.countDistinct("run_id").alias("runs"), F.sum("checked_rows").alias("checked_rows"), F.sum("failed_rows").alias("failed_rows"), F.max("run_at").alias("last_run_at"))
    return summed.withColumn("pass_rate", ratio(F.col("checked_rows") - F.col("failed_rows"), F.col("checked_rows")))


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def is_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value is not within the bounds; nulls pass."""
    return df.where((F.col(column) < low) | (F.col(column) > high))


def not_accepted(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def unmasked(customers: DataFrame) -> DataFrame:
    """Rows in which an address or a number is not hidden; nulls pass."""
    return customers.where("email_masked not like '%***@%' or not phone_masked rlike '[*]{5}'")


def several_current(**dimensions: tuple[DataFrame, str]) -> DataFrame:
    """(dim, id) of keys with more than one current version."""
    out = None
    for name, (df, key) in dimensions.items():
        found = not_unique(df.where("is_current"), key).select(F.lit(name).alias("dim"), F.col(key).alias("id"))
        out = found if out is None else out.unionByName(found)
    return out


def stale(loaded: DataFrame, at: str, now: Column, warn: str, error: str) -> DataFrame:
    """One row: age state of a source by its last load."""
    last = loaded.agg(F.max(at).alias("last"))
    return last.withColumn("state", F.when(F.col("last").isNull() | (F.col("last") < now - F.expr(f"interval {error}")), "error").when(F.col("last") < now - F.expr(f"interval {warn}"), "warn").otherwise("pass"))
