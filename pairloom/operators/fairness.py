"""Group fairness of rankings: representation parity, weights, re-ranking, selection rates and true-positive rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.operators.rank import DIGITS, topk
from pairloom.session import small_side

Z = 1.96
MIN_SUPPORT = 30
ALPHA, CLIP = 50.0, (0.85, 1.20)


def group_value(c: Column) -> Column:
    """A group's name for comparison: trimmed, lower case, blank and null as `missing`."""
    return F.lower(F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("missing")))


def population(resumes: DataFrame, key: str, attributes: list[str], order: str) -> DataFrame:
    """(resume_id, attributes...): one row per trimmed non-blank id, the last in order."""
    rows = resumes.select(F.nullif(F.trim(key), F.lit("")).alias("resume_id"), F.col(order).alias("_o"), *[group_value(F.col(a)).alias(a) for a in attributes]).where("resume_id IS NOT NULL")
    return rows.groupBy("resume_id").agg(*[F.max_by(a, "_o").alias(a) for a in attributes])


def long_groups(pop: DataFrame, attributes: list[str], intersection: list[str] | None = None) -> DataFrame:
    """(resume_id, attribute, group) for each attribute and, if named, their intersection joined by bars."""
    parts = [F.struct(F.lit(a).alias("attribute"), F.col(a).alias("group")) for a in attributes]
    if intersection:
        cols = list(dict.fromkeys(intersection))
        parts.append(F.struct(F.lit("|".join(cols)).alias("attribute"), F.concat_ws("|", *cols).alias("group")))
    return pop.select("resume_id", F.inline(F.array(*parts)))


def wilson(k: Column, n: Column, upper: bool) -> Column:
    """A bound of the Wilson interval of k successes in n trials, within [0, 1]; no trials give 0."""
    p = k / n
    d = 1 + Z * Z / n
    mid = (p + Z * Z / (2 * n)) / d
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mid + half if upper else mid - half)))


def shortlist(recs: DataFrame, k: int) -> DataFrame:
    """The first k of each job after repeated resumes are dropped, best score first."""
    best = recs.where("job_id IS NOT NULL AND resume_id IS NOT NULL").groupBy("job_id", "resume_id").agg(F.max("score").alias("score"))
    return topk(best, "job_id", "resume_id", k=k)


def parity(recs: DataFrame, pop: DataFrame, attributes: list[str], k: int = 10, min_support: int = MIN_SUPPORT, intersection: list[str] | None = None) -> DataFrame:
    """Representation parity per attribute and group of the population.

    The denominator is jobs times k, also for short lists. Recommendations of unknown resumes count in it but in no group.
    Groups under min_support have null ratio and difference and the note low_support.
    """
    top = shortlist(recs, k)
    selected = float(top.select("job_id").distinct().count() * k)
    people = float(pop.count())
    groups = long_groups(pop, attributes, intersection)
    base = groups.groupBy("attribute", "group").agg(F.count("*").alias("resume_count"))
    rec = top.select("resume_id").join(groups, "resume_id").groupBy("attribute", "group").agg(F.count("*").alias("rec_count"))
    j = base.join(rec, ["attribute", "group"], "left").withColumn("rec_count", F.coalesce("rec_count", F.lit(0)))
    n = F.lit(selected)
    share, part = F.when(n > 0, F.col("rec_count") / n).otherwise(0.0), F.col("resume_count") / F.lit(people)
    ok = F.col("resume_count") >= min_support
    return j.select(
        "attribute", "group", "resume_count", F.lit(int(people)).cast("long").alias("total_resumes"), "rec_count", F.lit(int(selected)).cast("long").alias("total_selected"),
        F.round(share, DIGITS).alias("share_selected"), F.round(wilson(F.col("rec_count"), n, False), DIGITS).alias("share_selected_lo"), F.round(wilson(F.col("rec_count"), n, True), DIGITS).alias("share_selected_hi"),
        F.round(part, DIGITS).alias("base_share"), F.round(F.when(ok, share / part), DIGITS).alias("parity_ratio"), F.round(F.when(ok, (share - part) * 100), DIGITS).alias("parity_diff_pp"), F.when(ok, "").otherwise("low_support").alias("note"),
    )


def parity_summary(audit: DataFrame) -> DataFrame:
    """Per attribute the worst (least) ratio and difference and whether the four-fifths rule holds; no supported group gives 1, 0 and true."""
    return audit.groupBy("attribute").agg(F.coalesce(F.min("parity_ratio"), F.lit(1.0)).alias("worst_ratio"), F.coalesce(F.min("parity_diff_pp"), F.lit(0.0)).alias("worst_diff_pp")).withColumn("rule_80_pass", F.col("worst_ratio") >= 0.8)


def parity_per_job(recs: DataFrame, pop: DataFrame, attributes: list[str], k: int = 10) -> DataFrame:
    return shortlist(recs, k).join(long_groups(pop, attributes), "resume_id").groupBy("job_id", "attribute", "group").agg(F.count("*").alias("rec_count")).withColumn("share_selected", F.round(F.col("rec_count") / float(k), DIGITS))


def group_weights(audit: DataFrame, alpha: float = ALPHA, clip: tuple[float, float] = CLIP) -> DataFrame:
    """(attribute, group, weight): base share over shrunk selected share, clipped, divided by the attribute's mean. Blank attributes are skipped."""
    rows = audit.where("attribute IS NOT NULL AND attribute <> ''").select("attribute", group_value(F.col("group")).alias("group"), F.col("share_selected").alias("share"), F.col("base_share").alias("base"), F.col("total_selected").cast("double").alias("n"))
    w = W.partitionBy("attribute")
    mean = F.coalesce(F.avg(F.when(F.col("base") > 0, F.col("base"))).over(w), 1.0 / F.count("*").over(w))
    n = F.greatest(F.max("n").over(w), F.lit(1.0))
    shrunk = (F.col("share") * n + alpha * mean) / (n + alpha)
    raw = F.when(F.col("base") > 0, F.col("base") / F.greatest(shrunk, F.lit(1e-6))).otherwise(0.0)
    clipped = rows.select("attribute", "group", F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), raw)).alias("c"))
    return clipped.select("attribute", "group", F.round(F.col("c") / F.avg("c").over(w), DIGITS).alias("weight"))


def rerank(recs: DataFrame, pop: DataFrame, weights: DataFrame, attributes: list[str], k: int = 10, source: str = "adjusted") -> DataFrame:
    """Scores times the geometric mean of the resume's group weights (1 where unknown), ranked anew; of repeated pairs the first in rank order counts."""
    once = recs.where("job_id IS NOT NULL AND resume_id IS NOT NULL").groupBy("job_id", "resume_id").agg(F.min_by("score", F.struct("rank", F.col("score"))).alias("score"))
    j = once.join(pop, "resume_id", "left")
    for a in attributes:
        j = j.withColumn(a, F.coalesce(a, F.lit("missing"))).join(small_side(weights.where(F.col("attribute") == a).select(F.col("group").alias(a), F.col("weight").alias(f"w_{a}"))), a, "left")
    logs = sum((F.log(F.coalesce(f"w_{a}", F.lit(1.0))) for a in attributes), F.lit(0.0))
    j = j.withColumn("score", F.coalesce("score", F.lit(0.0)) * F.exp(logs / float(len(attributes))))
    return topk(j.select("job_id", "resume_id", "score"), "job_id", "resume_id", k=k).withColumn("source", F.lit(source))


def selection(selected: DataFrame, pool: DataFrame, pop: DataFrame, attributes: list[str], k: int = 10) -> DataFrame:
    """(job_id, resume_id, group, y_pred): all pairs of the pool and the selection; selected if ranked within k. Unknown resumes form the group `unknown`."""
    best = selected.where("job_id IS NOT NULL AND resume_id IS NOT NULL").groupBy("job_id", "resume_id").agg(F.max("rank").alias("rank"))
    pairs = pool.select("job_id", "resume_id").where("job_id IS NOT NULL AND resume_id IS NOT NULL").unionByName(best.select("job_id", "resume_id")).distinct()
    name = F.concat_ws("|", *[F.concat(F.lit(a + "="), F.coalesce(F.col(a), F.lit(""))) for a in attributes])
    groups = pop.select("resume_id", name.alias("group"))
    return pairs.join(best, ["job_id", "resume_id"], "left").join(groups, "resume_id", "left").select("job_id", "resume_id", F.coalesce("group", F.lit("unknown")).alias("group"), F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)).alias("y_pred"))


def selection_rates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group").agg(F.count("*").alias("count"), F.round(F.avg("y_pred"), DIGITS).alias("selection_rate"))


def dp_summary(rows: DataFrame) -> DataFrame:
    """Overall rate, demographic-parity difference and ratio; one row."""
    per = rows.groupBy("group").agg(F.avg("y_pred").alias("r"), F.sum("y_pred").alias("y"), F.count("*").alias("n"))
    return per.agg(F.round(F.sum("y") / F.sum("n"), DIGITS).alias("overall"), F.round(F.max("r") - F.min("r"), DIGITS).alias("dp_difference"), F.round(F.when(F.max("r") > 0, F.min("r") / F.max("r")).otherwise(1.0), DIGITS).alias("dp_ratio"))


def true_positive_rates(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(group, count_labelled, tpr) over labelled pairs; a group without positives has a null rate."""
    j = rows.join(labels, ["job_id", "resume_id"])
    return j.groupBy("group").agg(F.count("*").alias("count_labelled"), F.round(F.avg(F.when(F.col("y") == 1, F.col("y_pred"))), DIGITS).alias("tpr"))


def tpr_difference(rates: DataFrame) -> DataFrame:
    """One row `tpr_diff`: the largest less the smallest rate of the groups with positives; 0 for fewer than two such groups."""
    return rates.where("tpr IS NOT NULL").agg(F.round(F.when(F.count("*") > 1, F.max("tpr") - F.min("tpr")).otherwise(0.0), DIGITS).alias("tpr_diff"))


def parity_report(audit: DataFrame, recs: DataFrame, k: int = 10) -> DataFrame:
    """The audit's rows and one `__SUMMARY__` row per attribute, with `place`: by attribute, then falling population, then group, the summary last.

    The summary has the worst ratio and difference and a note with the four-fifths rule and the share of jobs with full lists.
    Lists are counted after repeated resumes are dropped; without jobs the share is 0.
    """
    full = shortlist(recs, k).groupBy("job_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("jobs"), F.coalesce(F.sum((F.col("n") >= k).cast("int")), F.lit(0)).alias("full")).first()
    share = 100.0 * full.full / full.jobs if full.jobs else 0.0
    cols = ["attribute", "group", "resume_count", "rec_count", "parity_ratio", "parity_diff_pp", "note"]
    note = F.concat(F.lit("rule_80_pass="), F.col("rule_80_pass").cast("string"), F.lit(f"; jobs_full_k={share:.1f}% ({full.full}/{full.jobs})"))
    summary = parity_summary(audit).select("attribute", F.lit("__SUMMARY__").alias("group"), F.lit(None).cast("long").alias("resume_count"), F.lit(None).cast("long").alias("rec_count"), F.col("worst_ratio").alias("parity_ratio"), F.col("worst_diff_pp").alias("parity_diff_pp"), note.alias("note"))
    w = W.partitionBy("attribute").orderBy(F.col("resume_count").desc_nulls_last(), "group")  # the groups of one attribute
    return audit.select(*cols).unionByName(summary).withColumn("place", F.row_number().over(w))
