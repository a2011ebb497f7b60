"""A linear surrogate of relevance with exact linear SHAP values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("inv_rank_a", "inv_rank_b", "overlap", "len_resume", "len_job")


def pair_features(pairs: DataFrame, a: DataFrame, b: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, resume_id, y, features): inverse ranks in two rankings (0 where absent), shared tokens over the job's tokens, log lengths."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    inv = lambda d, n: d.select("job_id", "resume_id", (1.0 / F.col("rank")).alias(n)).groupBy("job_id", "resume_id").agg(F.max(n).alias(n))
    j = pairs.join(inv(a, "inv_rank_a"), ["job_id", "resume_id"], "left").join(inv(b, "inv_rank_b"), ["job_id", "resume_id"], "left")
    j = j.join(resumes.select(F.col("id").alias("resume_id"), F.col("text").alias("rt")), "resume_id").join(jobs.select(F.col("id").alias("job_id"), F.col("text").alias("jt")), "job_id")
    return j.select(
        "job_id", "resume_id", F.col("y").cast("double").alias("y"), F.coalesce("inv_rank_a", F.lit(0.0)).alias("inv_rank_a"), F.coalesce("inv_rank_b", F.lit(0.0)).alias("inv_rank_b"),
        (F.size(F.array_intersect(tokens(F.col("rt")), tokens(F.col("jt")))) / F.greatest(F.size(tokens(F.col("jt"))), F.lit(1))).alias("overlap"), F.log1p(F.length("rt")).alias("len_resume"), F.log1p(F.length("jt")).alias("len_job"),
    )


def surrogate(features: DataFrame, names: tuple[str, ...] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """SHAP values per pair (job_id, resume_id, feature, shap) of a logistic regression, w * (x - mean x), and their mean size per feature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    model = LogisticRegression(featuresCol="v", labelCol="y", maxIter=30, regParam=1e-3).fit(VectorAssembler(inputCols=list(names), outputCol="v").transform(features))
    means = features.agg(*[F.avg(n).alias(n) for n in names]).first()
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.round(float(w) * (F.col(n) - F.lit(float(means[n]))), 6).alias("shap")) for n, w in zip(names, model.coefficients)])
    pairs = features.select("job_id", "resume_id", F.inline(parts))
    return pairs, pairs.groupBy("feature").agg(F.round(F.avg(F.abs("shap")), 6).alias("mean_abs_shap"))
