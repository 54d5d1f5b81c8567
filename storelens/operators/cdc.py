"""Change-data-capture operators: envelopes, typed images, latest rows, versions and point-in-time joins.

Changes of a key are ordered by (ts_ms, kafka_offset); offsets order them only
within one partition, as a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.scalars import OPEN_FROM, OPEN_TO, from_millis, surrogate_key, timestamp_ntz

#: Row images by table; decimals travel as strings and are cast here.
IMAGES = {
    "orders": "order_id long, customer_id long, session_id string, status string, payment_method string, shipping_fee string, order_total string, ship_province string, placed_at string",
    "order_items": "order_id long, product_id long, quantity int, unit_price string",
    "customers": "customer_id long, first_name string, last_name string, email string, phone string, province string, city string, marketing_opt_in boolean, created_at string",
    "products": "product_id long, sku string, product_name string, category string, price string, cost string",
    "inventory": "product_id long, stock_on_hand int, reorder_level int",
}
CASTS = {"shipping_fee": "decimal(10,2)", "order_total": "decimal(12,2)", "unit_price": "decimal(12,2)", "price": "decimal(12,2)", "cost": "decimal(12,2)", "placed_at": "timestamp_ntz", "created_at": "timestamp_ntz"}
KEYS = {"orders": ["order_id"], "order_items": ["order_id", "product_id"], "customers": ["customer_id"], "products": ["product_id"], "inventory": ["product_id"]}


def _names(table: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in IMAGES[table].split(",")]


def to_envelopes(changes: DataFrame, table: str, *keep: str) -> DataFrame:
    """(value, kafka_offset) and the columns in keep: changes as the JSON a change stream carries, images before and after."""
    names = _names(table)
    texts = [F.col(c).cast("string").alias(c) if c in CASTS else F.col(c) for c in names]
    image = F.struct(*texts)
    w = Window.partitionBy(*KEYS[table]).orderBy("ts_ms", "kafka_offset")
    staged = changes.withColumn("_image", image).withColumn("_before", F.lag("_image").over(w))
    source = F.struct(F.lit(table).alias("table"), F.col("ts_ms").alias("ts_ms"))
    envelope = F.struct(F.col("_before").alias("before"), F.when(F.col("op") != "d", F.col("_image")).alias("after"), F.col("op"), source.alias("source"))
    return staged.select(F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"), "kafka_offset", *keep)


def parse_envelopes(stream: DataFrame) -> DataFrame:
    """(table_name, op, ts_ms, kafka_offset, before_json, after_json) of change messages, each read once; junk is dropped."""
    message = F.from_json("value", "before string, after string, op string, source struct<table: string, ts_ms: string>")
    # Junk goes inside the generator: a filter behind it would be moved before it, and build and read each message once more for each of its terms.
    sound = F.filter(F.array(message), lambda m: m["source"]["table"].isNotNull() & m["op"].isNotNull())
    return stream.select(F.explode(sound).alias("m"), "kafka_offset").select(
        F.col("m.source.table").alias("table_name"),
        F.col("m.op").alias("op"),
        F.col("m.source.ts_ms").try_cast("long").alias("ts_ms"),
        "kafka_offset",
        *(F.when(F.col(f"m.{side}") != "null", F.col(f"m.{side}")).alias(f"{side}_json") for side in ("before", "after")),
    )


def typed(parsed: DataFrame, table: str) -> DataFrame:
    """One table's changes: op, is_deleted, times and the image's columns, read from the JSON once."""
    image = F.from_json(F.coalesce("after_json", "before_json"), IMAGES[table])
    own = parsed.where(F.col("table_name") == table).select("op", "ts_ms", "kafka_offset", image.alias("i"), F.get_json_object("before_json", "$.status").alias("previous_status"))
    names = _names(table)
    columns = [F.col(f"i.{c}").try_cast(CASTS[c]).alias(c) if c in CASTS else F.col(f"i.{c}") for c in names]
    previous = ["previous_status"] if table == "orders" else []
    return changes(own.select("op", "ts_ms", "kafka_offset", *columns, *previous))


class Wanted(NamedTuple):
    """What readers take of a table's changes: columns of its images, and those changes for whose op ``when`` holds."""

    columns: Iterable[str]
    when: Callable[[Column], Column]


def images(stream: DataFrame, wanted: Mapping[str, Wanted], *keep: str) -> DataFrame:
    """(table_name, op, ts_ms, kafka_offset, image, previous_status) of the wanted tables' changes, and the columns in keep.

    A message is read once, and of its images only what is wanted; all else of it is
    dropped here, before anything moves the rows.
    """
    types = {name: kind for t in wanted for name, kind in (c.strip().split(" ") for c in IMAGES[t].split(","))}
    names = dict.fromkeys(c for t, w in wanted.items() for c in types if c in w.columns and c in _names(t))
    image = ", ".join(f"{c}: {types[c]}" for c in names)
    before = image if "status" in names else ", ".join([image, "status: string"])
    message = F.from_json("value", f"before struct<{before}>, after struct<{image}>, op string, source struct<table: string, ts_ms: string>")
    taken = lambda m: reduce(or_, ((m["source"]["table"] == t) & F.coalesce(w.when(m["op"]), F.lit(False)) for t, w in wanted.items()))
    # Inside the generator, as in parse_envelopes: a filter behind it would read each message again.
    m = stream.select(F.explode(F.filter(F.array(message), lambda m: m["op"].isNotNull() & taken(m))).alias("m"), "kafka_offset", *keep)
    last = F.struct(*(F.when(F.col("m.after").isNotNull(), F.col(f"m.after.{c}")).otherwise(F.col(f"m.before.{c}")).alias(c) for c in names))
    return m.select(F.col("m.source.table").alias("table_name"), F.col("m.op").alias("op"), F.col("m.source.ts_ms").try_cast("long").alias("ts_ms"), "kafka_offset", *keep, last.alias("image"), F.col("m.before.status").alias("previous_status"))


def typed_images(read: DataFrame, table: str, columns: Iterable[str]) -> DataFrame:
    """One table's changes from what ``images`` gives, with some of its columns, as ``typed`` has them."""
    values = (F.col(f"image.{c}").try_cast(CASTS[c]).alias(c) if c in CASTS else F.col(f"image.{c}").alias(c) for c in columns)
    return changes(read.where(F.col("table_name") == table).select("op", "ts_ms", "kafka_offset", *values, *(["previous_status"] if table == "orders" else [])))


def changes(log: DataFrame) -> DataFrame:
    """Adds is_deleted and changed_at."""
    return log.withColumns({"is_deleted": F.col("op") == "d", "changed_at": from_millis(F.col("ts_ms"))})


def latest(log: DataFrame, *keys: str, keep: Iterable[str] | None = None) -> DataFrame:
    """The last change of every key, merged before the shuffle; of its columns those in keep, or all."""
    rest = [c for c in (log.columns if keep is None else dict.fromkeys(keep)) if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts_ms", "kafka_offset")).alias("_row"))
    return last.select(*keys, *(F.col(f"_row.{c}") for c in rest))


def live(log: DataFrame, *keys: str, keep: Iterable[str] | None = None) -> DataFrame:
    """The last change of every key whose last change is no delete."""
    found = latest(log, *keys, keep=None if keep is None else [*keep, "is_deleted"])
    return found.where("not is_deleted") if keep is None else found.where("not is_deleted").drop("is_deleted")


def versions(log: DataFrame, key: str, *tie_break: str, span: str | None = None) -> DataFrame:
    """Every change as a version with half-open validity.

    The first one is valid from 1900 on, the last one up to 9999; a delete is a
    version that is never current.  Changes in one instant leave versions of no
    length, which no time falls into.

    With a ``span`` (year, quarter, ...) the changes of a key are numbered in time
    ranges, each by a task of its own: a narrow table has for each range how many
    changes lie before it and when the next one begins, and goes into the range as
    its first row.  Without one a key is one range, which is cheaper where no key
    has a large share of all changes.
    """
    if span is None:
        w = Window.partitionBy(key).orderBy("ts_ms", "kafka_offset", *tie_break)
        numbered = log.withColumns({"version": F.row_number().over(w), "_next": F.lead("changed_at").over(w)})
    else:
        rows = log.withColumns({"_part": F.date_trunc(span, F.col("changed_at")).cast("timestamp_ntz"), "_before": F.lit(None).cast("long"), "_after": F.lit(None).cast("timestamp_ntz")})
        ranges = rows.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("changed_at").alias("_first"))
        by_key = Window.partitionBy(key).orderBy("_part")
        marks = ranges.withColumns({"_before": F.sum("_n").over(by_key) - F.col("_n"), "_after": F.lead("_first").over(by_key)}).select(key, "_part", "_before", "_after")
        w = Window.partitionBy(key, "_part").orderBy(F.col("_before").isNull(), "ts_ms", "kafka_offset", *tie_break)
        both = rows.unionByName(marks, allowMissingColumns=True).withColumns({"version": F.row_number().over(w), "_next": F.lead("changed_at").over(w), "_start": F.first("_before").over(w), "_end": F.first("_after").over(w)})
        numbered = both.where(F.col("_before").isNull()).withColumns({"version": (F.col("version") - 1 + F.col("_start")).cast("int"), "_next": F.coalesce("_next", "_end")})
    return numbered.withColumns(
        {
            "valid_from": F.when(F.col("version") == 1, timestamp_ntz(OPEN_FROM)).otherwise(F.col("changed_at")),
            "valid_to": F.coalesce("_next", timestamp_ntz(OPEN_TO)),
            "is_current": F.col("_next").isNull() & ~F.col("is_deleted"),
            "is_last": F.col("_next").isNull(),
        }
    ).drop("_next", "_part", "_before", "_after", "_start", "_end")


def as_of(facts: DataFrame, dimension: DataFrame, key: str, at: str, columns: list[str], span: str | None = None, carry: str | None = None) -> DataFrame:
    """Adds to each fact the columns of the version that was valid at its time; none found gives nulls.

    Versions of a key do not overlap.  With a ``span`` versions and facts are
    sorted together by time and the last version is carried forward, so no fact
    meets more than one.  The rows of a key are divided by time ranges, and the
    version that is valid when a range begins goes into it as its first row.
    With ``carry`` and no span a key is one range: versions that lie by key already
    stay where they are, and each fact is moved once; ``carry`` names one more
    column, the key by which facts then lie, or any number where they have none.
    Without both facts join their key's versions, which is cheaper where a key
    has a few.  A fact without a key or time has no version; those without a key
    lie apart by their time.
    """
    if span is None and carry is not None:
        versioned = dimension.where((F.col("valid_from") < F.col("valid_to")) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("valid_from").alias("_at"), F.lit(1).alias("_kind"), F.struct("valid_to", *columns).alias("_v"))
        apart = F.xxhash64(at).cast(facts.schema[key].dataType)
        dated = facts.select(F.coalesce(key, apart).alias("_key"), F.col(at).alias("_at"), F.lit(2).alias("_kind"), F.struct(*facts.columns).alias("_f")).repartition("_key")
        rows = dated.unionByName(versioned, allowMissingColumns=True)
        found = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))).where("_kind = 2")
        valid = F.col(f"_f.{key}").isNotNull() & (F.col("_at") < F.col("_v.valid_to"))
        return found.select("_f.*", *(F.when(valid, F.col(f"_v.{c}")).alias(c) for c in columns), F.col("_key").alias(carry))
    if span is None:
        right = dimension.select(F.col(key).alias("_key"), "valid_from", "valid_to", *columns)
        return facts.join(right, (F.col(key) == F.col("_key")) & (F.col(at) >= F.col("valid_from")) & (F.col(at) < F.col("valid_to")), "left").drop("_key", "valid_from", "valid_to")
    whole = lambda c: F.date_trunc(span, c).cast("timestamp_ntz")
    versioned = dimension.where((F.col("valid_from") < F.col("valid_to")) & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), whole(F.col("valid_from")).alias("_part"), F.col("valid_from").alias("_at"), F.lit(1).alias("_kind"), F.struct("valid_to", *columns).alias("_v")
    )
    part = F.when(F.col(key).isNull(), F.col(at).cast("timestamp_ntz")).otherwise(whole(F.col(at)))
    dated = facts.select(F.col(key).alias("_key"), part.alias("_part"), F.col(at).alias("_at"), F.lit(2).alias("_kind"), F.struct(*facts.columns).alias("_f"))
    asked = dated.where("_key is not null").select("_key", "_part", F.lit(True).alias("_asked"))
    marks = versioned.select("_key", "_part", "_at", "_v").unionByName(asked, allowMissingColumns=True)
    ranges = marks.groupBy("_key", "_part").agg(F.max_by("_v", "_at").alias("_v"), F.max("_asked").alias("_asked"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where("_asked and _v is not null")
    rows = dated.unionByName(versioned, allowMissingColumns=True).unionByName(carried.select("_key", "_part", F.col("_part").alias("_at"), F.lit(0).alias("_kind"), "_v"), allowMissingColumns=True)
    found = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(Window.partitionBy("_key", "_part").orderBy("_at", "_kind"))).where("_kind = 2")
    valid = F.col("_key").isNotNull() & (F.col("_at") < F.col("_v.valid_to"))
    lies_by = [] if carry is None else [F.col("_key").alias(carry)]
    return found.select("_f.*", *(F.when(valid, F.col(f"_v.{c}")).alias(c) for c in columns), *lies_by)


def _milestones() -> list[Column]:
    first = lambda status: F.min(F.when(F.col("status") == status, F.col("changed_at")))
    return [
        first("PAID").alias("paid_at"),
        first("SHIPPED").alias("shipped_at"),
        first("DELIVERED").alias("delivered_at_shop"),
        first("CANCELLED").alias("cancelled_at"),
        F.count_if(F.col("op") == "u").alias("status_changes"),
    ]


def milestones(log: DataFrame) -> DataFrame:
    """First time of each state of an order, and how often it changed."""
    return log.groupBy("order_id").agg(*_milestones())


def order_states(log: DataFrame) -> DataFrame:
    """The last change of every order that is not deleted, with its milestones, in one pass over the log."""
    rest = [c for c in log.columns if c != "order_id"]
    last = log.groupBy("order_id").agg(F.max_by(F.struct(*rest), F.struct("ts_ms", "kafka_offset")).alias("_row"), *_milestones())
    kept = [c for c in last.columns if c not in ("order_id", "_row")]
    return last.select("order_id", *(F.col(f"_row.{c}") for c in rest), *kept).where("not is_deleted")


def with_key(df: DataFrame, name: str, *parts: str) -> DataFrame:
    return df.withColumn(name, surrogate_key(*(F.col(p) for p in parts)))


def signed_board(log: DataFrame) -> DataFrame:
    """(status, orders) now, as a sum of signed steps: associative, so the order of changes is free."""
    steps = F.array_compact(
        F.array(
            F.when(F.col("op") != "d", F.struct(F.col("status").alias("status"), F.lit(1).alias("n"))),
            F.when(F.col("op") == "u", F.struct(F.col("previous_status").alias("status"), F.lit(-1).alias("n"))),
            F.when(F.col("op") == "d", F.struct(F.col("status").alias("status"), F.lit(-1).alias("n"))),
        )
    )
    return log.select(F.explode(steps).alias("s")).groupBy("s.status").agg(F.sum("s.n").alias("orders"))


def previous_status(log: DataFrame) -> Column:
    return F.lag("status").over(Window.partitionBy("order_id").orderBy("ts_ms", "kafka_offset"))
