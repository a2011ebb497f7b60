"""Learning on the job-resume graph: BPR loss, LightGCN and mean-aggregating GraphSAGE, trained by driver-stepped Spark jobs.

Only values of fixed size (losses, weight matrices, validation metrics) come to the driver; node values stay in tables
(node, vec).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.operators.graph import adjacency, both_ways, initial_vectors, int_index, mean_of, propagated, vectors_are_small
from pairloom.session import cut

REG = 1e-4


def log_sigmoid(c: Column) -> Column:
    """ln(1 / (1 + exp(-x))), stable for large negative x."""
    return F.least(c, F.lit(0.0)) - F.log1p(F.exp(-F.abs(c)))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def bpr_loss(triples: DataFrame, reg: float = REG) -> DataFrame:
    """One row `loss` for triples with vectors u, p, n: mean of -ln sigmoid(u.p - u.n) plus reg times the squared norms by batch size. No triple gives null."""
    return triples.agg(F.round(F.avg(-log_sigmoid(dot("u", "p") - dot("u", "n"))) + reg * F.sum(dot("u", "u") + dot("p", "p") + dot("n", "n")) / F.count("*"), 6).alias("loss"))


def triples_of(pairs: DataFrame, index: DataFrame, n_index: int, batch: int, seed: int, draws: int = 4) -> DataFrame:
    """(u, p, n) node names: about `batch` positives by a hash, each with a resume of its own that its job is not linked to.

    index: (resume_id, idx) of all resumes. Each positive draws a few numbers; the first that is no link of its job counts,
    and a positive whose draws are all links is left out of this batch.
    """
    share = min(1.0, batch / max(pairs.count(), 1))
    take = pairs.where(F.pmod(F.xxhash64(F.lit(seed), "job_id", "resume_id"), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    drawn = take.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("idx", F.pmod(F.xxhash64(F.lit(seed), "job_id", "resume_id", "draw"), F.lit(max(n_index, 1))))
    free = drawn.join(index.withColumnRenamed("resume_id", "neg"), "idx").join(pairs.select("job_id", F.col("resume_id").alias("neg")), ["job_id", "neg"], "left_anti")
    one = free.groupBy("job_id", "resume_id").agg(F.min_by("neg", "draw").alias("neg"))
    return one.select(F.concat(F.lit("job_"), "job_id").alias("u"), F.concat(F.lit("resume_"), "resume_id").alias("p"), F.concat(F.lit("resume_"), "neg").alias("n"))


def with_vectors(t: DataFrame, x: DataFrame) -> DataFrame:
    """Triples of names with their vectors: columns u, p, n and their names nu, np, nn."""
    for c in ("u", "p", "n"):
        t = t.withColumnRenamed(c, "n" + c).join(x.select(F.col("node").alias("n" + c), F.col("vec").alias(c)), "n" + c)
    return t


def validation_set(labels: DataFrame, index: DataFrame, n_index: int, jobs: int = 800, candidates: int = 800, seed: int = 42) -> DataFrame:
    """(job_id, resume_id, y): of up to `jobs` labelled jobs, chosen by a hash, the labelled resumes and drawn ones up to about `candidates` in all, those with y = 0. The bounds are parameters of the reference's sampled validation."""
    known = labels.join(index.select("resume_id"), "resume_id", "left_semi").groupBy("job_id", "resume_id").agg(F.max("y").alias("y"))
    chosen = known.groupBy("job_id").agg(F.count("*").alias("have")).orderBy(F.xxhash64(F.lit(seed), "job_id")).limit(jobs)
    own = known.join(F.broadcast(chosen.select("job_id")), "job_id")
    drawn = chosen.where(F.col("have") < candidates).select("job_id", F.explode(F.sequence(F.lit(1), F.lit(candidates) - F.col("have").cast("int"))).alias("d")).withColumn("idx", F.pmod(F.xxhash64(F.lit(seed), "job_id", "d"), F.lit(max(n_index, 1))))
    other = drawn.join(index, "idx").select("job_id", "resume_id").distinct().join(own.select("job_id", "resume_id"), ["job_id", "resume_id"], "left_anti").withColumn("y", F.lit(0))
    return own.select("job_id", "resume_id", F.col("y").cast("int").alias("y")).unionByName(other)


def validate(x: DataFrame, val: DataFrame, k: int = 10) -> float:
    """MAP@k over the validation set's jobs by cosine; jobs without a hit count 0; no job gives 0."""
    norm = lambda c: F.sqrt(dot(c, c))
    j = val.join(x.select(F.expr("substring(node, 5)").alias("job_id"), F.col("vec").alias("a")).where("node LIKE 'job_%'"), "job_id").join(x.select(F.expr("substring(node, 8)").alias("resume_id"), F.col("vec").alias("b")).where("node LIKE 'resume_%'"), "resume_id")
    ranked = j.withColumn("s", F.round(dot("a", "b") / F.greatest(norm("a") * norm("b"), F.lit(1e-12)), 6)).withColumn("r", F.row_number().over(W.partitionBy("job_id").orderBy(F.col("s").desc(), "resume_id"))).where(F.col("r") <= k)
    seen = ranked.withColumn("hits", F.sum("y").over(W.partitionBy("job_id").orderBy("r")))
    per = seen.groupBy("job_id").agg((F.sum(F.col("y") * F.col("hits") / F.col("r")) / F.greatest(F.sum("y"), F.lit(1))).alias("ap"))
    return float(per.agg(F.avg("ap")).first()[0] or 0.0)


class Stopper:
    """Keeps the best state by a validation value; done when it has not improved for `patience` evaluations."""

    def __init__(self, patience: int):
        self.patience, self.best, self.state, self.since = patience, float("-inf"), None, 0

    def done(self, value: float, state) -> bool:
        if value > self.best + 1e-6:
            self.best, self.state, self.since = value, state, 0
        else:
            self.since += 1
        return self.since >= self.patience


def _prepared(pairs: DataFrame, labels: DataFrame | None, seed: int):
    edges = pairs.select(F.concat(F.lit("job_"), "job_id").alias("src"), F.concat(F.lit("resume_"), "resume_id").alias("dst"))
    index = cut(int_index(pairs.select("resume_id"), "resume_id"))
    n = index.count()
    return edges, index, n, cut(validation_set(labels, index, n, seed=seed)) if labels is not None else None


def lightgcn(pairs: DataFrame, labels: DataFrame | None = None, dims: int = 64, hops: int = 3, epochs: int = 50, rate: float = 2e-3, batch: int = 8192, every: int = 2, patience: int = 6, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """Node values (node, vec) after training, and the loss before each step.

    Each epoch draws a fresh batch and makes one Adam step; with labels (job_id, resume_id, y) every `every` epochs MAP@10 on
    a fixed sample is taken, training stops after `patience` such without gain, and the best values are returned. A is
    symmetric, so the gradient of the initial values is that of the final ones, propagated the same way.
    """
    edges, index, n_index, val = _prepared(pairs, labels, seed)
    adj = cut(adjacency(edges))
    small = vectors_are_small(adj, dims)
    x0 = initial_vectors(adj.select(F.col("src").alias("node")), dims, seed).withColumn("vec", F.transform("vec", lambda v: v * 0.1))
    state = cut(x0.withColumns({"m": F.array_repeat(F.lit(0.0), dims), "v": F.array_repeat(F.lit(0.0), dims)}))
    pairs = cut(pairs)
    losses, stop = [], Stopper(patience)
    for epoch in range(1, epochs + 1):
        x = cut(propagated(adj, state.select("node", "vec"), dims, hops, small))
        if val is not None and (epoch == 1 or epoch % every == 0) and stop.done(validate(x, val), x):
            break
        t = cut(with_vectors(triples_of(pairs, index, n_index, batch, seed + epoch), x))
        count, loss = t.agg(F.count("*"), F.avg(-log_sigmoid(dot("u", "p") - dot("u", "n")))).first()
        losses.append(float(loss or 0.0))
        g = t.withColumn("g", -1.0 / (1.0 + F.exp(dot("u", "p") - dot("u", "n"))) / F.lit(float(max(count, 1)))).withColumn("r", F.lit(2 * REG / max(count, 1)))
        grad = lambda a, b, c, sign: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.col("g") * sign * (F.get(b, i) - (F.get(c, i) if c else F.lit(0.0))) + F.col("r") * F.get(a, i))
        parts = F.array(F.struct(F.col("nu").alias("node"), grad("u", "p", "n", 1.0).alias("vec")), F.struct(F.col("np").alias("node"), grad("p", "u", None, 1.0).alias("vec")), F.struct(F.col("nn").alias("node"), grad("n", "u", None, -1.0).alias("vec")))
        back = propagated(adj, mean_of([g.select(F.inline(parts))], dims, 1.0), dims, hops, small).withColumnRenamed("vec", "d")
        d = F.coalesce("d", F.array_repeat(F.lit(0.0), dims))
        moved = state.join(back, "node", "left").withColumn("d", d).withColumn("m", F.zip_with("m", "d", lambda a, b: 0.9 * a + 0.1 * b)).withColumn("v", F.zip_with("v", "d", lambda a, b: 0.999 * a + 0.001 * b * b))
        step = F.zip_with("m", "v", lambda a, b: rate * (a / (1 - 0.9**epoch)) / (F.sqrt(b / (1 - 0.999**epoch)) + 1e-8))
        state = cut(moved.select("node", F.zip_with("vec", step, lambda a, b: a - b).alias("vec"), "m", "v"))
    if stop.state is not None:
        return stop.state, losses
    return propagated(adj, state.select("node", "vec"), dims, hops, small), losses


def _dense(w: np.ndarray, relu: bool):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                h = np.hstack([np.stack(pdf["vec"].to_numpy()), np.stack(pdf["mean"].to_numpy())]) @ w
                yield pd.DataFrame({"node": pdf["node"], "vec": list(np.maximum(h, 0) if relu else h)})

    return run


def sage_layer(edges: DataFrame, x: DataFrame, w: np.ndarray, relu: bool) -> DataFrame:
    """(node, vec): [own; mean of neighbours] times w; nodes without neighbours take zeros as the mean."""
    dims = w.shape[0] // 2
    mean = edges.join(x.select(F.col("node").alias("dst"), "vec"), "dst").groupBy(F.col("src").alias("node")).agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(dims)]).alias("mean"))
    rows = x.join(mean, "node", "left").withColumn("mean", F.coalesce("mean", F.array_repeat(F.lit(0.0), dims)))
    return cut(rows.select("node", "vec", "mean").mapInPandas(_dense(w, relu), "node string, vec array<double>"))


def graphsage(pairs: DataFrame, labels: DataFrame | None = None, dims: int = 64, steps: int = 50, rate: float = 0.2, batch: int = 8192, every: int = 2, patience: int = 6, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """Node values of two mean-aggregating layers, and the losses. The weights are trained on the BPR loss by simultaneous perturbation, two forward passes a step, each step with a fresh batch; early stopping as for lightgcn."""
    own, index, n_index, val = _prepared(pairs, labels, seed)
    edges = cut(both_ways(own))
    x0 = cut(initial_vectors(edges.select(F.col("src").alias("node")), dims, seed))
    rng = np.random.default_rng(seed)
    ws = [rng.normal(0, (2 * dims) ** -0.5, (2 * dims, dims)) for _ in range(2)]
    pairs = cut(pairs)

    def forward(ws: list[np.ndarray]) -> DataFrame:
        return sage_layer(edges, sage_layer(edges, x0, ws[0], True), ws[1], False)

    losses, stop = [], Stopper(patience)
    for step in range(1, steps + 1):
        t = cut(triples_of(pairs, index, n_index, batch, seed + step))
        loss = lambda ws, t=t: float(bpr_loss(with_vectors(t, forward(ws))).first()[0] or 0.0)
        d = [rng.choice([-1.0, 1.0], w.shape) for w in ws]
        a, b = loss([w + 0.05 * x for w, x in zip(ws, d)]), loss([w - 0.05 * x for w, x in zip(ws, d)])
        losses.append((a + b) / 2)
        g = np.clip((a - b) / 0.1, -1, 1)
        ws = [w - rate * 0.05 * g * x for w, x in zip(ws, d)]
        if val is not None and (step == 1 or step % every == 0) and stop.done(validate(forward(ws), val), ws):
            break
    return forward(stop.state or ws), losses
