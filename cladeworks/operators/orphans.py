"""References whose target is missing, already deleted, or loaded only later.

Method. Parent rows become two marks on a time line (valid from ``loaded_at``, ended at ``deleted_at``) and references a
third; marks and references are partitioned by (key, hour), sorted by time and merged in one pass of running sums: a
reference is sound where more intervals have begun than ended. What earlier hours of the key carry in comes from sums
per (key, hour), which are combined before the shuffle. So a key that holds a third of all rows is spread over its hours,
and one task never sees more than the bare hour sums of a key.

Defined results: null and zero references do not count; a reference without a time can be checked against nothing and
comes out with status ``missing``, ``late`` or so by the parent rows, month null; a parent row without ``loaded_at`` is
never valid; repeated rows count once in the report's distinct ids; an interval that ends before it begins is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Time span whose rows of one key are merged in one task; equal references of one instant are one row before.
SPAN = "hour"


def references(table: str, df: DataFrame, key: str, at: str = "loaded_at") -> DataFrame:
    """The references of one table as ``ref_table, ref_id, at``."""
    ref = F.col(key).cast("bigint")
    return df.select(F.lit(table).alias("ref_table"), ref.alias("ref_id"), F.col(at).alias("at")).filter(ref.isNotNull() & (ref != 0))


def check_references(refs: DataFrame, parents: DataFrame, key: str = "taxon_id", start: str = "loaded_at", end: str = "deleted_at") -> DataFrame:
    """``ref_table, ref_id, at, n_refs, status`` with status ``valid``, ``missing``, ``deleted`` or ``late``.

    Equal references (table, id, time) are one row with their number. Nothing is broadcast.
    """
    same = refs.groupBy("ref_table", "ref_id", "at").agg(F.count(F.lit(1)).alias("n_refs"))
    none = F.lit(0).cast("bigint")
    p = parents.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("ref_id"), F.col(start).alias("s"), F.col(end).alias("e"))
    p = p.groupBy("ref_id", "s", "e").agg(F.count(F.lit(1)).alias("c")).filter(F.col("s").isNotNull())
    open_ = F.col("e").isNull() | (F.col("e") > F.col("s"))
    mark = F.explode(F.array(
        F.struct(F.col("s").alias("at"), F.col("c").alias("born"), F.when(open_, F.col("c")).otherwise(none).alias("live")),
        F.struct(F.col("e").alias("at"), none.alias("born"), F.when(open_ & F.col("e").isNotNull(), -F.col("c")).otherwise(none).alias("live")),
    ))
    marks = p.select("ref_id", mark.alias("m")).select("ref_id", "m.*").filter((F.col("born") != 0) | (F.col("live") != 0))
    marks = marks.select(F.lit(None).cast("string").alias("ref_table"), "ref_id", "at", none.alias("n_refs"), "born", "live")
    events = same.select("ref_table", "ref_id", "at", "n_refs", none.alias("born"), none.alias("live")).unionByName(marks)
    # a reference without a time sorts before all marks and so meets no valid parent
    events = events.withColumn("span", F.coalesce(F.date_trunc(SPAN, "at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")))

    sums = events.groupBy("ref_id", "span").agg(F.sum("born").alias("b"), F.sum("live").alias("l"))
    by_key = Window.partitionBy("ref_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("ref_id")
    carried = sums.select(
        "ref_id", "span",
        F.coalesce(F.sum("b").over(by_key), none).alias("born_before"),
        F.coalesce(F.sum("l").over(by_key), none).alias("live_before"),
        F.sum("b").over(whole).alias("born_ever"),
    )
    # starts and ends at the reference's own instant count before it: loaded_at <= t and deleted_at > t
    in_day = Window.partitionBy("ref_id", "span").orderBy(F.col("at").asc_nulls_first(), F.when(F.col("n_refs") > 0, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, 0)
    merged = events.select("*", F.sum("born").over(in_day).alias("born_now"), F.sum("live").over(in_day).alias("live_now"))
    merged = merged.filter(F.col("n_refs") > 0).join(carried, ["ref_id", "span"])
    return merged.select("ref_table", "ref_id", "at", "n_refs", _status().alias("status"))


def _status() -> Column:
    live, born = F.col("live_before") + F.col("live_now"), F.col("born_before") + F.col("born_now")
    return F.when(live > 0, "valid").when(born > 0, "deleted").when(F.col("born_ever") > 0, "late").otherwise("missing")


def orphans(checked: DataFrame) -> DataFrame:
    """Distinct orphan references: ``ref_table, load_month, ref_id, status``, with the number of rows."""
    month = F.date_format("at", "yyyy-MM").alias("load_month")
    return checked.filter(F.col("status") != "valid").groupBy("ref_table", month, "ref_id", "status").agg(F.sum("n_refs").alias("n_refs"))


def orphan_report(checked: DataFrame) -> DataFrame:
    """Per table and month: references, orphans by status and the orphan share."""
    month = F.date_format("at", "yyyy-MM").alias("load_month")
    count = lambda s: F.sum(F.when(F.col("status") == s, F.col("n_refs")).otherwise(0)).alias(f"n_{s}")
    return checked.groupBy("ref_table", month).agg(F.sum("n_refs").alias("n_refs"), *(count(s) for s in ("valid", "missing", "deleted", "late")))
