"""Top N items within every group, also where one group holds most rows (problem 7).

Method: partition lower bounds. Within each input partition the items of a group are spread over slices by a hash; the best
item of each slice is distinct from the others', so the N-th best of them bounds the group's N-th best overall. The best
bound of all partitions is joined to the rows and drops most rows of large groups before any shuffle; survivors are ranked.

Bounds are made only for groups with several times N rows a partition, where they drop most rows. These are at most
FREQUENT groups, so they are always broadcast; any other group has few rows in each partition or at most one in FREQUENT of
all rows, and is ranked as it is. All steps are in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom import session
from pairloom.session import cut

#: A group gets bounds from this many times N rows a partition on average; its items are spread over this many times N slices.
LARGE, SLICES = 2, 4


def large_groups(rows: DataFrame, n: int, frequent: int = session.FREQUENT) -> DataFrame:
    """(g) of the groups worth a bound, at most `frequent`, with keys of bounded length."""
    counts = cut(rows.groupBy("g").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where((F.col("n") > max(LARGE * n * rows.rdd.getNumPartitions(), total // frequent)) & (F.octet_length("g") <= session.FREQUENT_BYTES)).orderBy(F.col("n").desc(), "g").limit(frequent).select("g")


def bounds(rows: DataFrame, large: DataFrame, n: int) -> DataFrame:
    """(g, bs, bi): negated score and item that at least n items of the group reach; groups without such are left out."""
    own = rows.join(F.broadcast(large), "g").select("g", F.spark_partition_id().alias("p"), F.pmod(F.xxhash64("i"), F.lit(SLICES * n)).alias("slice"), F.struct((-F.col("s")).alias("ns"), "i").alias("x"))
    best = own.groupBy("g", "p", "slice").agg(F.min("x").alias("x"))  # at most SLICES * n a partition and group leave the map side
    local = best.groupBy("g", "p").agg(F.get(F.array_sort(F.collect_list("x")), F.lit(n - 1)).alias("b")).where("b IS NOT NULL")
    return local.groupBy("g").agg(F.min("b").alias("b")).select("g", F.col("b.ns").alias("bs"), F.col("b.i").alias("bi"))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, place: str = "place") -> DataFrame:
    """(group, item, score, place): the first n items of each group by descending score, ties by ascending item (code points).

    A repeated (group, item) counts once with its highest score. Rows with null group or item, or null or NaN score, do not
    count; -0.0 equals 0.0; infinite scores rank as such. Groups with fewer than n items keep all; an empty table gives an empty result. Other columns of
    df are ignored, whatever their names. Very long keys are compared whole.
    """
    rows = df.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{item}`").cast("string").alias("i"), (F.col(f"`{score}`").cast("double") + F.lit(0.0)).alias("s")).where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    limits = cut(bounds(rows, large_groups(rows, n), n))  # at most FREQUENT rows
    left = rows.join(F.broadcast(limits), "g", "left").where("bs IS NULL OR -s < bs OR (-s = bs AND i <= bi)")
    once = left.groupBy("g", "i").agg(F.max("s").alias("s"))
    w = W.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc())
    return once.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), place)
