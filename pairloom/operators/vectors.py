"""Vectors: normalisation, dot products and exact cosine top-k of a query set against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.rank import DIGITS, topk

#: Queries and rows of a block: a task multiplies one block of each.
BLOCK = 2048


def normalised(v: Column) -> Column:
    """The vector divided by its length; zero vectors stay, null stays null."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine_topk(queries: DataFrame, rows: DataFrame, left: str, right: str, vec: str = "vec", k: int = 10, block: int = BLOCK) -> DataFrame:
    """(left, right, score, rank): the k rows most similar to each query. Rows without a vector are skipped; k is at most the number of rows.

    Both sides are cut into blocks, and every block of queries meets every block of rows in a join of the two tables: nothing
    goes to the driver, tasks hold one block of each side, and only each pair of blocks' k best per query are shuffled.
    Repeated queries or rows are kept.
    """
    side = lambda df, key, n: df.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias(n), normalised(F.col(vec)).alias("v"))
    q, r = side(queries, left, "q"), side(rows, right, "r")
    nq = max(1, -(-q.count() // block))
    nr = max(1, -(-r.count() // block))
    put = lambda df, key, n, other: df.withColumn("b", F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    a = put(q, "q", nq, nr).select(F.col("b").alias("bq"), F.col("o").alias("br"), "q", "v")
    b = put(r, "r", nr, nq).select(F.col("o").alias("bq"), F.col("b").alias("br"), "r", "v")

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"q": [], "r": [], "score": []}).astype({"q": str, "r": str, "score": float})
        y = y.sort_values("r", kind="stable")
        names = y["r"].to_numpy()
        s = np.round(np.stack(x["v"].to_numpy()) @ np.stack(y["v"].to_numpy()).T, DIGITS) + 0.0
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"q": np.repeat(x["q"].to_numpy(), top.shape[1]), "r": names[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

    pairs = a.groupBy("bq", "br").cogroup(b.groupBy("bq", "br")).applyInPandas(best, "q string, r string, score double")
    return topk(pairs, "q", "r", k=k).select(F.col("q").alias(left), F.col("r").alias(right), "score", "rank")
