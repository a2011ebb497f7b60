"""Report queries over rankings, metrics and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Methods in display order, and aliases of metric names without signs.
METHODS = ("tfidf", "bm25", "node2vec", "lightgcn", "graphsage", "default")
ALIASES = {"patk": "p", "pat10": "p", "p10": "p", "pat10true": "p", "ndcgatk": "ndcg", "ndcg10": "ndcg", "ndcgat10": "ndcg", "ndcg10true": "ndcg", "mapatk": "map", "map10": "map", "mapat10": "map", "map10true": "map", "jobsscored": "jobs_scored", "source": "method", "method": "method", "model": "method", "algo": "method", "approach": "method", "name": "method"}


def resolve(df: DataFrame, aliases: list[str]) -> str | None:
    """The first column whose lower-case name is among the aliases, in their order."""
    by = {c.lower().strip(): c for c in reversed(df.columns)}
    return next((by[a.lower()] for a in aliases if a.lower() in by), None)


def jobs_index(jobs: DataFrame, key: str = "job_id", title: str = "title", order: str = "row_num", cut: int = 100) -> DataFrame:
    """(job_id, title, label): each trimmed non-blank id once with its first title, white space collapsed and cut."""
    rows = jobs.select(F.trim(key).alias("job_id"), F.substring(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")), 1, cut).alias("title"), F.col(order).alias("_o")).where("job_id <> ''")
    return rows.groupBy("job_id").agg(F.min_by("title", "_o").alias("title")).withColumn("label", F.concat("title", F.lit(" ["), "job_id", F.lit("]")))


def metric_name(name: str) -> str:
    """A metric column's common name, by its letters and digits."""
    return ALIASES.get("".join(c for c in name.lower() if c.isalnum()), name)


def normalised_metrics(df: DataFrame) -> DataFrame:
    """(method, p, ndcg, map, jobs_scored) from a table under any of the aliases; missing columns are null, rows without any value are dropped."""
    named = {metric_name(c): c for c in reversed(df.columns)}
    cols = [F.col(f"`{named[m]}`").cast(t).alias(m) if m in named else F.lit(None).cast(t).alias(m) for m, t in (("method", "string"), ("p", "double"), ("ndcg", "double"), ("map", "double"), ("jobs_scored", "long"))]
    return df.select(*cols).where("p IS NOT NULL OR ndcg IS NOT NULL OR map IS NOT NULL")


def unpivoted(metrics: DataFrame) -> DataFrame:
    """(method, metric, value) of the known methods."""
    return metrics.where(F.col("method").isin(*METHODS)).unpivot(["method"], ["p", "ndcg", "map"], "metric", "value")


def pick(metrics: DataFrame, method: str = "tfidf") -> DataFrame:
    """The method's row, else the first in display order; at most one row."""
    place = F.when(F.col("method") == method, 0).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, METHODS)), F.col("method")), F.lit(0)), F.lit(99)))
    return metrics.withColumn("_p", place).orderBy("_p", "method").limit(1).drop("_p")


def pre_post(pre: DataFrame, post: DataFrame) -> DataFrame:
    """(group, stage, selection_rate): group rates of both audits, 0 where a group is missing in one."""
    a, b = pre.select("group", F.col("selection_rate").alias("pre")), post.select("group", F.col("selection_rate").alias("post"))
    return a.join(b, "group", "full").na.fill(0.0, ["pre", "post"]).unpivot(["group"], ["pre", "post"], "stage", "selection_rate")


def number_in_text(c) -> object:
    """The first number within messy text; none gives null."""
    return F.nullif(F.regexp_extract(c, r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", 0), F.lit("")).try_cast("double")


def job_ids_in_ranking(ranking: DataFrame) -> DataFrame:
    """(job_id): the distinct trimmed job ids of a ranking under any of its spellings, else of its first column; blank and null ids are dropped."""
    col = resolve(ranking, ["job_id", "jobid", "job"]) or ranking.columns[0]
    return ranking.select(F.trim(F.col(f"`{col}`").cast("string")).alias("job_id")).where("job_id <> ''").distinct()


def options_in_ranking(index: DataFrame, ranking: DataFrame) -> DataFrame:
    """The entries of a jobs index whose job the ranking holds; all of them if it holds none."""
    ids = job_ids_in_ranking(ranking)
    return index.join(ids, "job_id", "left_semi") if ids.limit(1).count() else index


def shap_of_job(pairs: DataFrame, job_id: str) -> DataFrame:
    """(feature, mean_abs_shap) over one job's pairs, rounded to 6 digits."""
    return pairs.where(F.col("job_id") == job_id).groupBy("feature").agg(F.round(F.avg(F.abs("shap")), 6).alias("mean_abs_shap"))


def shap_of_pair(pairs: DataFrame, job_id: str, resume_id: str) -> DataFrame:
    """(feature, shap) of one pair; an unknown pair gives no rows."""
    return pairs.where((F.col("job_id") == job_id) & (F.col("resume_id") == resume_id)).select("feature", "shap")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n): how often each value of a column occurs, null included."""
    return df.groupBy(F.col(f"`{col}`").cast("string").alias("value")).agg(F.count("*").alias("n"))


def consistency(jobs: DataFrame, resumes: DataFrame, labels: DataFrame, least: int = 10) -> DataFrame:
    """(name, n, ok): numbers of distinct labelled jobs and resumes, labelled resumes and jobs that the corpora (id) lack, and resumes, with whether each is as it should be."""
    known = lambda col, side: labels.where(F.col(col).isNotNull()).select(F.col(col).alias("id")).distinct().join(side.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("n"))
    parts = [
        ("labelled_jobs", labels.agg(F.countDistinct("job_id").alias("n")), "n > 0"), ("labelled_resumes", labels.agg(F.countDistinct("resume_id").alias("n")), "n > 0"),
        ("missing_resumes", known("resume_id", resumes), "n = 0"), ("missing_jobs", known("job_id", jobs), "n = 0"), ("resumes", resumes.agg(F.countDistinct("id").alias("n")), f"n >= {least}"),
    ]
    out = None
    for name, df, ok in parts:
        one = df.select(F.lit(name).alias("name"), "n", F.expr(ok).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out
