"""References to records that do not exist, are deleted, or arrive later.

Method: the distinct whole-number keys of the referenced table are compressed into runs of consecutive values; a
reference is matched as-of to the last run start at or before it and is missing beyond that run's end. Keys are cut into
ranges of RANGE values, and runs at their borders, so that each range is matched on its own and no task sees all keys.
Keys that are no whole numbers are compared as strings. For known keys, life over time is a running sum of load and
delete events per key, with a daily roll-up, so that a key holding a third of all rows is spread over its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = 1 << 16
WHOLE = r"\A(0|[1-9][0-9]{0,17})\z"


def clean_key(c: Column) -> Column:
    """Without surrounding blanks and tabs; null where nothing is left."""
    return F.nullif(F.regexp_replace(c, r"\A[ \t]+|[ \t]+\z", ""), F.lit(""))


def parent_events(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(target, key, t, load, live): +1 when a row is loaded, -1 when it is deleted. A row deleted at or before its loading was never live; one never loaded has t null."""
    parts = []
    for target, (df, col) in tables.items():
        rows = df.select(F.lit(target).alias("target"), clean_key(F.col(col)).alias("key"), F.col("loaded_at"), F.col("deleted_at")).where("key IS NOT NULL")
        lived = F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("loaded_at"))
        ev = F.array(
            F.struct(F.col("loaded_at").alias("t"), F.lit(1).alias("load"), F.when(lived, 1).otherwise(0).alias("live")),
            F.struct(F.when(lived & F.col("loaded_at").isNotNull(), F.col("deleted_at")).alias("t"), F.lit(0).alias("load"), F.lit(-1).alias("live")),
        )
        parts.append(rows.select("target", "key", F.inline(ev)).where("t IS NOT NULL OR load = 1"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_runs(keys: DataFrame) -> DataFrame:
    """(target, bucket, first, last): runs of consecutive whole-number keys within each range of RANGE values; keys must be distinct."""
    k = keys.where(F.col("key").rlike(WHOLE)).select("target", F.col("key").cast("long").alias("k")).withColumn("bucket", F.floor(F.col("k") / RANGE))
    w = W.partitionBy("target", "bucket").orderBy("k")
    return k.withColumn("island", F.col("k") - F.row_number().over(w)).groupBy("target", "bucket", "island").agg(F.min("k").alias("first"), F.max("k").alias("last")).drop("island")


def missing_keys(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the distinct (target, key) in `wanted` that are not in the distinct `known`: as-of match against runs for whole numbers, anti-join for other keys."""
    whole = F.col("key").rlike(WHOLE)
    asked = wanted.where(whole).select("target", "key", F.col("key").cast("long").alias("k")).withColumn("bucket", F.floor(F.col("k") / RANGE))
    both = key_runs(known).select("target", "bucket", F.col("first").alias("k"), F.lit(0).alias("ask"), "last", F.lit(None).cast("string").alias("key")).unionByName(asked.select("target", "bucket", "k", F.lit(1).alias("ask"), F.lit(None).cast("long").alias("last"), "key"))
    w = W.partitionBy("target", "bucket").orderBy("k", "ask")
    numbers = both.withColumn("end", F.last("last", ignorenulls=True).over(w)).where("ask = 1 AND (end IS NULL OR k > end)").select("target", "key")
    return numbers.unionByName(wanted.where(~whole).join(known.where(~whole), ["target", "key"], "left_anti").select("target", "key"))


def orphans(refs: DataFrame, tables: dict[str, tuple[DataFrame, str]], carry: tuple[str, ...] = ()) -> DataFrame:
    """References without a live row at their time.

    refs: target (name of the referenced table), key, at, and the columns named in carry. Returns those with reason:
    `missing` (no row has the key), `deleted` (rows loaded by then, none live), `late` (rows loaded only afterwards, or
    never). Null and blank keys are no cases. Without a time only `missing` can be told. Repeated references are all
    reported; parents may repeat, overlap and be null; empty tables are valid. Other columns of the inputs do not matter.
    """
    r = refs.select("target", clean_key(F.col("key")).alias("key"), "at", *carry).where("key IS NOT NULL").withColumn("day", F.to_date("at"))
    ev = parent_events(tables).withColumn("day", F.to_date("t"))
    known = ev.select("target", "key").distinct()
    days = (
        ev.groupBy("target", "key", "day").agg(F.sum("load").alias("load"), F.sum("live").alias("live"))
        .unionByName(r.select("target", "key", "day").distinct().withColumns({"load": F.lit(0).cast("long"), "live": F.lit(0).cast("long")}))
        .groupBy("target", "key", "day").agg(F.sum("load").alias("load"), F.sum("live").alias("live"))
    )
    gone = missing_keys(r.select("target", "key").distinct(), known).withColumn("gone", F.lit(True))
    before = W.partitionBy("target", "key").orderBy(F.col("day").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    days = days.join(gone, ["target", "key"], "left").select("target", "key", "day", "gone", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("load", "live")])
    seen = r.withColumns({"ask": F.lit(1), "load": F.lit(0), "live": F.lit(0)}).withColumnRenamed("at", "t").unionByName(ev.where("day IS NOT NULL").withColumn("ask", F.lit(0)), allowMissingColumns=True)
    # references without a time need no order; they must not gather in one group
    seen = seen.withColumn("apart", F.when(F.col("day").isNull(), F.xxhash64(*carry, F.monotonically_increasing_id())).otherwise(F.lit(0)))
    within = W.partitionBy("target", "key", "day", "apart").orderBy("t", "ask").rowsBetween(W.unboundedPreceding, 0)
    summed = seen.select("*", F.sum("load").over(within).alias("load1"), F.sum("live").over(within).alias("live1")).where("ask = 1")
    on = (F.col("s.target") == F.col("d.target")) & (F.col("s.key") == F.col("d.key")) & F.col("s.day").eqNullSafe(F.col("d.day"))
    j = summed.alias("s").join(days.alias("d"), on)
    reason = F.when(F.col("d.gone"), "missing").when(F.col("s.t").isNull(), None).when(F.col("live0") + F.col("live1") > 0, None).when(F.col("load0") + F.col("load1") > 0, "deleted").otherwise("late")
    return j.select(F.col("s.target").alias("target"), F.col("s.key").alias("key"), F.col("s.t").alias("at"), *[F.col(f"s.{c}").alias(c) for c in carry], reason.alias("reason")).where("reason IS NOT NULL")


def label_refs(labels: DataFrame) -> DataFrame:
    """Both references of each label as (target, key, at, label_row, ref_column)."""
    pairs = F.array(F.struct(F.lit("postings_clean").alias("target"), F.lit("job_id").alias("ref_column"), F.col("job_id").alias("key")), F.struct(F.lit("resume_clean").alias("target"), F.lit("resume_id").alias("ref_column"), F.col("resume_id").alias("key")))
    return labels.select("label_row", F.col("labeled_at").alias("at"), F.inline(pairs))


def label_orphans(labels: DataFrame, resumes: DataFrame, postings: DataFrame) -> DataFrame:
    return orphans(label_refs(labels), {"postings_clean": (postings, "job_id"), "resume_clean": (resumes, "ID")}, carry=("label_row", "ref_column"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per referenced table, month and reason; references without a time count under a null month."""
    return found.groupBy("target", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("orphans"))
