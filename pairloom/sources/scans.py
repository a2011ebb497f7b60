"""Scans of particular files: shortlists of one job, match pairs, mapping files, metric and fairness tables, input directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.operators.rank import parse_rank
from pairloom.operators.report import number_in_text, resolve
from pairloom.sources.csv import header, read_table

# Header names of id and score columns by slug, and the bonus by which mapping files are preferred (of the name, of the path).
ID_NAMES = ("candidateid", "resumeid", "id", "filename", "file", "resume")
SCORE_NAMES = ("match", "matchpercentage", "matchpercent", "score", "target", "label", "percentage")
NAME_BONUS, PATH_BONUS = {"train.csv": 10}, {"train": 3, "dataset": 1}


def one_job(ranking: DataFrame, job_id: str, k: int = 10) -> DataFrame:
    """The first k recommendations of one job by rank; on Parquet the filter reaches the scan. An unknown job gives no rows."""
    return ranking.where(F.col("job_id") == job_id).withColumn("rank", parse_rank(F.col("rank"))).orderBy("rank", "resume_id").limit(k)


def ranks_by_order(recs: DataFrame, order: str) -> DataFrame:
    """Ranks from the order of rows per job, for lists without a rank column; of repeated pairs the largest rank counts."""
    n = recs.where("job_id IS NOT NULL AND resume_id IS NOT NULL").withColumn("rank", F.row_number().over(W.partitionBy("job_id").orderBy(order)))
    return n.groupBy("job_id", "resume_id").agg(F.max("rank").alias("rank"))


def top_labels(labels: DataFrame, k: int = 10) -> DataFrame:
    """(job_id, resume_id, match_percent, y): per job the k best matches are positive, ties by resume and row; null matches count as 0."""
    rows = labels.where("job_id IS NOT NULL AND resume_id IS NOT NULL").withColumn("match_percent", F.coalesce("match_percent", F.lit(0.0)))
    best = rows.groupBy("job_id", "resume_id").agg(F.max("match_percent").alias("match_percent"))
    w = W.partitionBy("job_id").orderBy(F.col("match_percent").desc(), "resume_id")
    return best.withColumn("y", (F.row_number().over(w) <= k).cast("int"))


def slug(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def files_below(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """The paths of the files below a folder of any file system, in order; none where it is missing. Only names are listed."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
        return sorted(r[0] for r in found.select("path").collect())
    except Exception:  # noqa: BLE001 - a folder that cannot be listed has no files
        return []


def find_mapping(spark: SparkSession, folder: str) -> str | None:
    """The CSV below a folder with an id-like and a score-like header, the best name first, then the first path; none if there is none."""
    found = []
    for path in files_below(spark, folder):
        names = {slug(c) for c in header(spark, path)[0]}
        if names & set(ID_NAMES) and names & set(SCORE_NAMES):
            low = path.lower()
            bonus = NAME_BONUS.get(low.rsplit("/", 1)[-1], 0) + sum(b for part, b in PATH_BONUS.items() if part in low)
            found.append((-bonus, path))
    return min(found)[1] if found else None


def pick_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first of the names that a column has as its slug, else the first column whose slug contains one of them."""
    by = {slug(c): c for c in reversed(columns)}
    return next((by[n] for n in names if n in by), next((c for c in columns if any(n in slug(c) for n in names)), None))


def match_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(resume_id, match_percent) of a mapping file: `.pdf` is cut from ids, numbers are read out of text, unreadable ones are 0. A file without such columns gives no rows."""
    df = read_table(spark, path)
    rid, score = pick_column(df.columns, ID_NAMES), pick_column(df.columns, SCORE_NAMES)
    if rid is None or score is None:
        return spark.createDataFrame([], "resume_id string, match_percent double")
    value = F.coalesce(F.regexp_replace(F.col(f"`{score}`"), r"[^\d.-]", "").try_cast("double"), F.lit(0.0))
    return df.select(F.regexp_replace(F.trim(F.col(f"`{rid}`")), r"\.pdf$", "").alias("resume_id"), value.alias("match_percent")).where("resume_id <> ''")


def overall_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """A metrics file, or of a folder `overall_metrics_true.csv`, else `overall_metrics.csv`; none if neither is there."""
    tries = [path] if path.lower().endswith(".csv") else [f"{path.rstrip('/')}/{n}" for n in ("overall_metrics_true.csv", "overall_metrics.csv")]
    hit = next((p for p in tries if files_below(spark, p)), None)
    return read_table(spark, hit) if hit else None


def fairness_values(df: DataFrame) -> DataFrame:
    """(key, value) of a fairness table of any of three layouts: key and value columns, one text column, or a text column and the first numeric one."""
    key = resolve(df, ["key", "metric", "name"])
    val = resolve(df, ["value", "val", "overall"])
    cols = [F.col(f"`{c}`").cast("string") for c in df.columns]
    number = lambda c: F.coalesce(c.try_cast("double"), number_in_text(c))
    if key and val:
        found = df.select(F.col(f"`{key}`").cast("string").alias("key"), number(F.col(f"`{val}`").cast("string")).alias("value"))
    elif len(cols) == 1:
        found = df.select(F.trim(F.regexp_extract(cols[0], r"^([^:=\d]*)", 1)).alias("key"), number_in_text(cols[0]).alias("value"))
    else:
        found = df.select(cols[0].alias("key"), F.coalesce(*[c.try_cast("double") for c in cols[1:]]).alias("value"))
    return found.where("value IS NOT NULL AND trim(key) <> ''")
