"""Mixing sources to target shares (problem 9).

Method: pivotal dependent rounding. Each document of a source gets the same expected number of copies, as far as its cap
allows. The whole copies are certain; the fractions are rounded in pairs: mass is moved at random between two documents,
keeping the expected size, until one of them is integral. Each task rounds a bounded bucket of documents and leaves at
most one fraction; these are combined in a tree of further buckets until one is left per source, which is rounded alone.
So every source misses its attainable size by less than one document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tokens import token_counts
from pairloom.session import cut, small_side

#: Documents that one task rounds together, and residues combined in a step of the tree.
BUCKET = 20_000
FAN = 64
EPS = 1e-9


def name_of(c):
    """A source's name without case and surrounding white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""))


def sizes(docs: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, _rid, src, tokens) of the documents of listed sources, sizes in tokens of the public tokenizer; null and empty texts have size 0.

    _rid is a digest of seed, doc_id, size and, where such rows repeat, their number: it does not depend on partitions.
    """
    listed = targets.select(name_of(F.col("source")).alias("src")).where("src IS NOT NULL").distinct()
    rows = docs.select("doc_id", "text", name_of(F.col("source")).alias("src"))
    sized = rows.join(small_side(listed), "src", "left_semi").select("doc_id", "src", F.pandas_udf(token_counts, "long")("text").alias("tokens"))
    copies = sized.groupBy("doc_id", "src", "tokens").agg(F.count("*").alias("n")).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BUCKET))))
    copies = copies.withColumn("nr", F.explode(F.sequence(F.col("block") * BUCKET + 1, F.least("n", (F.col("block") + 1) * BUCKET))))
    return copies.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "tokens", "nr").alias("_rid"), "src", "tokens")


def pivot(tokens: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds the fractions p so that sum(tokens * p) is kept; at most one value stays fractional."""
    p = p.copy()
    frac = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(frac) < 2:
        return p
    draws = rng.random(len(frac))
    i = -1
    for j, u in zip(frac, draws):
        if i < 0:
            i = j
            continue
        a, b = float(tokens[i]), float(tokens[j])
        up = min((1 - p[i]) * a, p[j] * b)  # mass that can move from j to i
        down = min(p[i] * a, (1 - p[j]) * b)
        move = up if u * (up + down) < down else -down  # the expected move is 0
        p[i] += move / a
        p[j] -= move / b
        for x in (i, j):
            if p[x] < EPS or p[x] > 1 - EPS:
                p[x] = round(p[x])
        if 0 < p[j] < 1:
            i = j
        elif not 0 < p[i] < 1:
            i = -1
    return p


def _round(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_rid", "doc_id", "tokens"], kind="stable")
        h = pd.util.hash_pandas_object(pd.Series([f"{seed}|{'|'.join(map(str, key))}"]), index=False)[0]
        rng = np.random.default_rng(int(h))
        p = pivot(pdf["tokens"].to_numpy(float), pdf["p"].to_numpy(float), rng)
        if last:
            p = np.where((p > EPS) & (p < 1 - EPS), (rng.random(len(p)) < p).astype(float), p)
        return pdf.assign(p=p)[["doc_id", "_rid", "src", "tokens", "base", "bucket", "p"]]

    return run


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: src, share, cap, docs, tokens (available), target (tokens), copies (expected per document)."""
    t = targets.select(name_of(F.col("source")).alias("src"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")).where("src IS NOT NULL").groupBy("src").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("cap"), F.lit(0)).alias("cap"))
    have = sized.groupBy("src").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    total = F.lit(int(have.agg(F.sum("tokens")).first()[0] or 0))
    j = t.join(have, "src", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    j = j.withColumn("target", F.col("share") * total)
    return j.withColumn("copies", F.when(F.col("tokens") > 0, F.least(F.col("target") / F.col("tokens"), F.col("cap").cast("double"))).otherwise(F.lit(0.0)))


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 42, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, src, tokens, copies) and the plan.

    Documents of unlisted or null sources and those of size 0 are never chosen. A source listed twice has its shares summed
    and the higher cap. A source whose cap does not allow its share gives all it can, and the report shows the shortfall;
    nothing is moved to other sources. Repeated rows are documents of their own. The choice depends on the documents and the
    seed only, not on partitions or their order.
    """
    sized = cut(sizes(docs, targets, seed))
    goal = cut(plan(sized, targets))
    rows = sized.where("tokens > 0").join(small_side(goal.select("src", "copies")), "src").withColumn("base", F.floor(F.col("copies") + EPS).cast("int")).withColumn("p", F.greatest(F.col("copies") - F.col("base"), F.lit(0.0)))
    most = goal.agg(F.max("docs")).first()[0] or 0
    buckets = max(1, -(-int(most) // bucket))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("_rid"), F.lit(buckets)).cast("long")).select("doc_id", "_rid", "src", "tokens", "base", "bucket", "p")
    schema = "doc_id long, _rid long, src string, tokens long, base int, bucket long, p double"
    open_, done, level = rows, [], 0
    while True:
        last = buckets == 1
        step = open_.groupBy("src", "bucket").applyInPandas(_round(seed + level, last), schema)
        if last:
            done.append(step)
            break
        step = cut(step)
        fractional = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(step.where(~fractional))
        open_ = step.where(fractional).withColumn("bucket", F.floor(F.col("bucket") / FAN))
        buckets, level = -(-buckets // FAN), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    chosen = out.select("doc_id", "src", "tokens", (F.col("base") + F.round("p").cast("int")).alias("copies")).where("copies > 0")
    return chosen, goal


def shares(chosen: DataFrame, goal: DataFrame) -> DataFrame:
    """Per listed source: target and reached tokens and shares of the total size, documents used and the most copies of one."""
    got = chosen.groupBy("src").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"))
    total = goal.agg(F.sum("tokens").alias("t")).first()[0] or 0
    return goal.join(got, "src", "left").select(
        F.col("src").alias("source"), F.col("share").alias("target_share"), F.round("target", 3).alias("target_tokens"), F.col("tokens").alias("available_tokens"), F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
        F.round(F.coalesce("reached_tokens", F.lit(0)) / F.lit(float(max(total, 1))), 6).alias("reached_share"), F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.col("cap").alias("max_repeats"),
    )
