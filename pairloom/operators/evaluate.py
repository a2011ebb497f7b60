"""Evaluation of rankings against labels: label rules and the families of P@K, nDCG@K and MAP@K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The accepted spellings of the text rules.
SPELLINGS = {"exact": ("1", "true", "True"), "yes": ("1", "true", "yes"), "wide": ("1", "true", "t", "yes", "y", "1.0")}
RULES = ("exact", "at_least_one", "positive", "number", "yes", "wide", "above_half")


def label_value(c: Column, rule: str) -> Column:
    """A label text as a truth value 0/1 by one of RULES; `number` gives the whole number itself; unreadable numbers are null for it and 0 else."""
    s = F.trim(c.cast("string"))
    number = s.try_cast("double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    if rule == "exact":
        return F.coalesce(s.isin(*SPELLINGS["exact"]).cast("int"), F.lit(0))
    if rule in ("yes", "wide"):
        return F.coalesce(F.lower(s).isin(*SPELLINGS[rule]).cast("int"), F.lit(0))
    if rule == "number":
        return whole.cast("int")
    test = {"at_least_one": whole >= 1, "positive": whole > 0, "above_half": number > 0.5}[rule]
    return F.coalesce(test.cast("int"), F.lit(0))


def label_matrix(labels: DataFrame, column: str) -> DataFrame:
    return labels.select(column, *[label_value(F.col(column), r).alias(f"rule_{r}") for r in RULES])


def clean_labels(labels: DataFrame, rule: str = "exact") -> DataFrame:
    """(job_id, resume_id, y): trimmed keys, the last label of a pair wins; null labels and blank keys are unknown and dropped."""
    key = lambda c: F.nullif(F.regexp_replace(F.col(c), r"\A[ \t]+|[ \t]+\z", ""), F.lit(""))
    rows = labels.where("label IS NOT NULL").select(key("job_id").alias("job_id"), key("resume_id").alias("resume_id"), label_value(F.col("label"), rule).alias("y"), "label_row").where("job_id IS NOT NULL AND resume_id IS NOT NULL")
    return rows.groupBy("job_id", "resume_id").agg(F.max_by("y", "label_row").alias("y"))


def hits(ranking: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """The first k of each job with y (null: unknown), running hits and discounts."""
    top = ranking.where(F.col("rank") <= k).select("job_id", "resume_id", "rank")
    j = top.join(labels, ["job_id", "resume_id"], "left").withColumn("hit", F.coalesce("y", F.lit(0)))
    w = W.partitionBy("job_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return j.withColumn("seen", F.sum("hit").over(w)).withColumn("dcg", F.col("hit") / F.log2(F.col("rank") + 1.0)).withColumn("prec", F.col("hit") * F.col("seen") / F.col("rank"))


def ideal(n: Column, k: int) -> Column:
    """The best possible DCG of n hits within k places."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda acc, i: acc + F.when(i <= n, 1.0 / F.log2(i + 1.0)).otherwise(0.0))


def per_job(ranking: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """(job_id, hits, labelled, dcg, prec, positives): sums over the first k, and all positives of the job's labels."""
    sums = hits(ranking, labels, k).groupBy("job_id").agg(F.sum("hit").alias("hits"), F.count("y").alias("labelled"), F.sum("dcg").alias("dcg"), F.sum("prec").alias("prec"))
    pos = labels.groupBy("job_id").agg(F.sum("y").alias("positives"))
    return sums.join(pos, "job_id", "left").withColumn("positives", F.coalesce("positives", F.lit(0)))


def evaluate(ranking: DataFrame, labels: DataFrame, variant: str, source: str, k: int = 10, digits: int = 6) -> DataFrame:
    """One row (source, p_at_k, ndcg_at_k, map_at_k, jobs_scored).

    labelled: jobs with a labelled item in the first k; ideal from the hits found; all: every job, unknown is 0, nDCG from
    pooled sums; precision: every job, P only; positives: every job, ideal and AP from the job's positives, at most k.
    Jobs without hits score 0. No job at all gives nulls and 0 jobs.
    """
    j = per_job(ranking, labels, k)
    found, total = ideal(F.col("hits"), k), ideal(F.least("positives", F.lit(k)), k)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    if variant == "labelled":
        j = j.where("labelled > 0")
    p = F.sum("hits") / (F.count("*") * float(k))
    ap = safe(F.col("prec"), F.least("positives", F.lit(k))) if variant == "positives" else safe(F.col("prec"), F.col("hits"))
    ndcg = {
        "labelled": F.avg(safe(F.col("dcg"), found)),
        "all": F.sum("dcg") / F.sum(F.when(found > 0, found).otherwise(1.0)),
        "positives": F.avg(safe(F.col("dcg"), total)),
        "precision": F.lit(None).cast("double"),
    }[variant]
    ap_out = F.lit(None).cast("double") if variant == "precision" else F.avg(ap)
    return j.agg(F.round(p, digits).alias("p_at_k"), F.round(ndcg, digits).alias("ndcg_at_k"), F.round(ap_out, digits).alias("map_at_k"), F.count("*").alias("jobs_scored")).select(F.lit(source).alias("source"), "*")
