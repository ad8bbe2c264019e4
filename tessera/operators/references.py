"""References to records that are not there: never delivered, withdrawn, or delivered only later.

Parent deliveries and child references are brought into one long form (parent table, key, time, change); a
reference holds if the running sum of changes at its time is positive.  Groups are (parent table, key, period),
so that a hot key is split over all periods in which it is used; what a key carries into a period comes from a
small pre-aggregate of the parent rows.  A group that holds at least ``HOT_SHARE`` of all references, or more than
``LARGEST`` of them, is split over as many tasks as it has times ``LARGEST`` rows (``SALTS`` at least), each with a copy
of the parent's changes.  The list of such groups is broadcast up to ``MOST_SENT`` of them and joined otherwise.  Groups
lacking a live parent keep their references as orphans, and the report sums them by table and period.

Defined results: a null or blank code is no reference; a reference without a time is an orphan (nothing was there
at an unknown time); a parent without loaded_at, or withdrawn before or when it was loaded, is never there; repeated
parents may overlap; codes are compared trimmed and in upper case; an empty parent table makes every reference an
orphan; an empty child table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

HOT_SHARE, SALTS = 0.002, 32
LARGEST, MOST_SENT = 500_000, 50_000


@dataclass(frozen=True)
class Parent:
    name: str
    rows: DataFrame
    key: str
    since: str = "loaded_at"
    until: str = "deleted_at"


@dataclass(frozen=True)
class Reference:
    table: str
    rows: DataFrame
    column: str
    parent: str
    row_id: str = "id"
    at: str = "loaded_at"


def code(c: str | Column) -> Column:
    """A code as compared: without surrounding spaces, in upper case; blank is null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c != "", F.upper(c))


def orphans(parents: list[Parent], references: list[Reference], period: str = "day") -> DataFrame:
    """(table_name, ref_column, row_id, parent_table, key, at): the references that nothing answered when they were loaded."""
    when = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    events = []
    for p in parents:
        live = p.rows.select(F.lit(p.name).alias("parent"), code(p.key).alias("key"), when(p.since).alias("since"), when(p.until).alias("until"))
        live = live.where("key is not null and since is not null and (until is null or since < until)")
        events.append(live.select("parent", "key", F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("change")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("change")))).alias("e")).select("parent", "key", "e.*").where("at is not null"))
    changes = reduce(DataFrame.unionByName, events).groupBy("parent", "key", "at").agg(F.sum("change").alias("change"))
    slot = F.date_trunc(period, F.timestamp_micros("at"))
    changes = changes.withColumn("slot", slot)

    refs = reduce(
        DataFrame.unionByName,
        [r.rows.select(F.lit(r.table).alias("table_name"), F.lit(r.column).alias("ref_column"), F.col(r.row_id).alias("row_id"), F.lit(r.parent).alias("parent"), code(r.column).alias("key"), when(r.at).alias("at")).where("key is not null") for r in references],
    )
    refs = refs.withColumn("slot", slot)

    # what each used period of a key starts with: one row a (key, period), whatever the number of references
    group = ["parent", "key", "slot"]
    used = cut(refs.where("at is not null").groupBy(*group).agg(F.count("*").alias("n")))
    total = used.agg(F.sum("n")).first()[0] or 0
    many = F.greatest(F.lit(SALTS), F.ceil(F.col("n") / F.lit(LARGEST))).cast("int")
    hot = used.where(F.col("n") >= F.lit(max(1.0, min(HOT_SHARE * total, LARGEST)))).select(*group, many.alias("hot"))
    if hot.limit(MOST_SENT + 1).count() <= MOST_SENT:
        hot = F.broadcast(hot)
    net = changes.groupBy(*group).agg(F.sum("change").alias("net")).unionByName(used.select(*group, F.lit(0).cast("long").alias("net"))).groupBy(*group).agg(F.sum("net").alias("net"))
    before = Window.partitionBy("parent", "key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = net.withColumn("change", F.coalesce(F.sum("net").over(before), F.lit(0))).where("change <> 0")
    carried = carried.select(*group, F.lit(None).cast("long").alias("at"), "change")

    none = {"table_name": F.lit(None).cast("string"), "ref_column": F.lit(None).cast("string"), "row_id": F.lit(None).cast("bigint")}
    salts = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.col("hot") - 1)).otherwise(F.array(F.lit(0)))
    state = changes.unionByName(carried).withColumns(none).join(hot, group, "left").withColumn("salt", F.explode(salts)).drop("hot")
    children = refs.where("at is not null").withColumn("change", F.lit(0).cast("long")).join(hot, group, "left")
    children = children.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("table_name", "ref_column", "row_id"), F.col("hot")).cast("int")).otherwise(0)).drop("hot")
    upto = Window.partitionBy(*group, "salt").orderBy(F.col("at").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    judged = children.unionByName(state).withColumn("there", F.sum("change").over(upto)).where("table_name is not null and there <= 0")
    untimed = refs.where("at is null")
    cols = ["table_name", "ref_column", "row_id", F.col("parent").alias("parent_table"), "key", F.timestamp_micros("at").alias("at")]
    return judged.select(*cols).unionByName(untimed.select(*cols))


def orphan_counts(found: DataFrame, period: str = "month") -> DataFrame:
    return found.groupBy("table_name", "ref_column", F.date_trunc(period, "at").alias("period")).agg(F.count("*").alias("n_orphans"), F.countDistinct("key").alias("n_codes"))
