"""Rankings: deterministic top-k, zero-score top-up, overlap, coverage, deduplication and rank deltas.

Order everywhere: rounded score descending, then id ascending as a string. Scores are rounded before ranking, since sums
of doubles depend on the order of distributed partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 6
BAD_RANK = 1_000_000_000


def parse_rank(c: Column) -> Column:
    """A rank from text or number; bad or missing values sort last."""
    return F.coalesce(c.cast("string").try_cast("int"), F.lit(BAD_RANK))


def parse_score(*cols: Column) -> Column:
    """The first non-empty of the columns as a score; if that one is no number, 0."""
    return F.coalesce(F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols]).try_cast("double"), F.lit(0.0))


def topk(pairs: DataFrame, left: str, right: str, score: str = "score", k: int = 10) -> DataFrame:
    """The k best pairs of each left id, with rank from 1. Null ids are dropped, null scores count as 0. Fewer than k pairs stay as they are. The rank limit is pushed below the shuffle."""
    rows = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn(score, F.round(F.coalesce(score, F.lit(0.0)), DIGITS) + F.lit(0.0))
    w = W.partitionBy(left).orderBy(F.col(score).desc(), F.col(right).asc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fill_zeros(pairs: DataFrame, queries: DataFrame, candidates: DataFrame, left: str, right: str, k: int = 10) -> DataFrame:
    """Adds, for left ids with fewer than k pairs of non-zero score, pairs of score 0 in id order, as if every pair had been scored.

    The k smallest candidate ids always suffice, so k ids are added per short list instead of a cross product.
    """
    found = pairs.withColumn("score", F.round("score", DIGITS) + F.lit(0.0)).where("score <> 0").select(left, right, "score")
    pool = [r[0] for r in candidates.select(right).where(F.col(right).isNotNull()).distinct().orderBy(right).limit(k).collect()]  # k ids
    have = found.groupBy(left).agg(F.count("*").alias("n"))
    short = queries.select(left).where(F.col(left).isNotNull()).distinct().join(have, left, "left").where(F.coalesce("n", F.lit(0)) < k).select(left, F.explode(F.array(*[F.lit(x) for x in pool]) if pool else F.array().cast("array<string>")).alias(right))
    zeros = short.join(found.select(left, right), [left, right], "left_anti").withColumn("score", F.lit(0.0))
    return found.unionByName(zeros)


def best_pairs(rows: DataFrame, left: str, right: str, score: str = "score") -> DataFrame:
    """Each pair once with its best score; null keys and null or NaN scores are dropped."""
    return rows.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).groupBy(left, right).agg(F.max(score).alias(score))


def first_rows(rows: DataFrame, keys: list[str], order: list[str], keep_null: bool = False) -> DataFrame:
    """The first row of each key in the given order; rows with a null key are dropped or, if wanted, all kept."""
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    one = known.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return one.unionByName(rows.where(" OR ".join(f"`{k}` IS NULL" for k in keys))) if keep_null else one


def overlap_at10(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common items of two rankings over ten times the jobs in both; one row. No common job gives 0."""
    cut_ = lambda d: d.where("rank <= 10").select("job_id", "resume_id").distinct()
    a10, b10 = cut_(a), cut_(b)
    jobs = a10.select("job_id").intersect(b10.select("job_id")).agg(F.count("*").alias("jobs"))
    both = a10.intersect(b10).agg(F.count("*").alias("common"))
    return both.withColumn("k", F.lit(1)).join(jobs.withColumn("k", F.lit(1)), "k").select("common", "jobs", F.round(F.when(F.col("jobs") > 0, F.col("common") / (10.0 * F.col("jobs"))).otherwise(0.0), DIGITS).alias("overlap"))


def consensus(rankings: dict[str, DataFrame]) -> DataFrame:
    """Mean overlap of each method with the other non-empty methods: (source, p_at_10)."""
    parts = []
    names = sorted(rankings)
    for a in names:
        for b in names:
            if a != b:
                parts.append(overlap_at10(rankings[a], rankings[b]).where("jobs > 0").select(F.lit(a).alias("source"), "overlap"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source").agg(F.round(F.avg("overlap"), 4).alias("p_at_10"))


def coverage(ranking: DataFrame, k: int = 10) -> DataFrame:
    """Jobs with at least k recommendations, all jobs, and the fraction; one row."""
    per = ranking.where("rank <= " + str(k)).groupBy("job_id").agg(F.count("*").alias("n"))
    return per.agg(F.sum(F.when(F.col("n") >= k, 1).otherwise(0)).cast("long").alias("full"), F.count("*").alias("jobs"), F.round(F.avg(F.when(F.col("n") >= k, 1.0).otherwise(0.0)), DIGITS).alias("fraction"))


def rank_delta(pre: DataFrame, post: DataFrame, k: int = 10) -> DataFrame:
    """The first k of the earlier shortlist with their later rank and the change, null where they dropped out."""
    p = pre.where(F.col("rank") <= k).select("job_id", "resume_id", F.col("rank").alias("rank_pre"))
    q = post.select("job_id", "resume_id", F.col("rank").alias("rank_post"))
    return p.join(q, ["job_id", "resume_id"], "left").withColumn("delta", F.col("rank_post") - F.col("rank_pre"))
