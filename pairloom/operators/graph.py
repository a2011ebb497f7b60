"""Graphs of resumes, jobs and skills, and of interactions: edges, degrees, adjacency, propagation, walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.session import BROADCAST_BYTES, BROADCAST_ROWS, FREQUENT, cut, frequent_join, small_side

DIGITS = 6


def interactions(*rankings: DataFrame) -> DataFrame:
    """Distinct (job_id, resume_id) of several rankings, null keys dropped."""
    out = rankings[0].select("job_id", "resume_id")
    for r in rankings[1:]:
        out = out.unionByName(r.select("job_id", "resume_id"))
    return out.where("job_id IS NOT NULL AND resume_id IS NOT NULL").distinct()


def int_index(ids: DataFrame, col: str, parts: int = 64) -> DataFrame:
    """(col, idx): 0..n-1 in id order. Ids are counted per range of a range partitioning, so no task sorts them all."""
    one = ids.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(parts, col).select(col, F.spark_partition_id().alias("p"))
    one = cut(one)
    before = one.groupBy("p").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("p", "base")  # one row per part
    return one.withColumn("i", F.row_number().over(W.partitionBy("p").orderBy(col)) - 1).join(small_side(before), "p").select(col, (F.col("base") + F.col("i")).alias("idx"))


def skill_graph(resume_skills: DataFrame, job_skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, node_type) and undirected edges (src, dst) of (id, skills) tables; entities without skills stay as nodes."""
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("id", F.explode("skills").alias("s")).select(F.concat(F.lit(prefix), "id").alias("src"), F.concat(F.lit("skill_"), "s").alias("dst"))

    edges = side(resume_skills, "resume_").unionByName(side(job_skills, "job_")).distinct()
    nodes = resume_skills.select(F.concat(F.lit("resume_"), "id").alias("node"), F.lit("resume").alias("node_type")).unionByName(job_skills.select(F.concat(F.lit("job_"), "id").alias("node"), F.lit("job").alias("node_type"))).unionByName(edges.select(F.col("dst").alias("node"), F.lit("skill").alias("node_type"))).distinct()
    return nodes, edges


def edge_hash(edges: DataFrame) -> DataFrame:
    """A fingerprint of an edge set: MD5 over the number of its distinct `min-max` edges and the sums of four 28-bit parts of their MD5s. Sums commute, so it needs no order, no direction and no task that holds the edges."""
    e = edges.select(F.md5(F.concat(F.least("src", "dst"), F.lit("-"), F.greatest("src", "dst"))).alias("h")).distinct()
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring("h", 1 + 7 * i, 7), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return e.agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), *[part(i) for i in range(4)])).alias("graph_hash"))


def graph_of_cached(resume_ids: DataFrame, job_ids: DataFrame, resume_skills: DataFrame, job_skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """skill_graph from stored (id, skills) maps and the full lists of ids (id): an id that the map lacks stays as a node without edges."""
    whole = lambda ids, m: ids.select("id").where("id IS NOT NULL").distinct().join(m.select("id", "skills").dropDuplicates(["id"]), "id", "full").select("id", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))
    return skill_graph(whole(resume_ids, resume_skills), whole(job_ids, job_skills))


def without_embeddings(nodes: DataFrame, embedded: DataFrame) -> DataFrame:
    """(which, id, reason): resume and job nodes (node, node_type) that have no embedding (node)."""
    left = nodes.where("node_type IN ('resume', 'job')").join(embedded.select("node").distinct(), "node", "left_anti")
    return left.select(F.col("node_type").alias("which"), F.expr("substring(node, length(node_type) + 2)").alias("id"), F.lit("no_embedding").alias("reason"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of both directions with w = 1 / sqrt(degree(src) * degree(dst))."""
    d = degrees(edges)
    return both_ways(edges).join(d.withColumnsRenamed({"node": "src", "degree": "ds"}), "src").join(d.withColumnsRenamed({"node": "dst", "degree": "dd"}), "dst").select("src", "dst", (1.0 / F.sqrt(F.col("ds").cast("double") * F.col("dd"))).alias("w"))


def seeded(node: Column, dim: Column, seed: int = 42) -> Column:
    """A reproducible value in [-1, 1) of a node and dimension, from a digest that other engines can compute too."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), node, F.lit("|"), dim.cast("string"))), 1, 7)
    return F.conv(h, 16, 10).cast("double") / float(1 << 27) - 1.0


def initial(nodes: DataFrame, dims: int, seed: int = 42) -> DataFrame:
    """(node, dim, x) of every node."""
    return nodes.select("node").distinct().withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(dims - 1)))).withColumn("x", seeded(F.col("node"), F.col("dim"), seed))


def initial_vectors(nodes: DataFrame, dims: int, seed: int = 42) -> DataFrame:
    """(node, vec) of every node, the values of initial() as one array."""
    return nodes.select("node").distinct().withColumn("vec", F.array(*[seeded(F.col("node"), F.lit(i), seed) for i in range(dims)]))


def vectors_are_small(adj: DataFrame, dims: int) -> bool:
    """Whether the vectors of all nodes of an adjacency may be broadcast, by their number and size."""
    n = adj.select("src").distinct().count()
    return n <= BROADCAST_ROWS and n * (8 * dims + 60) <= BROADCAST_BYTES


def one_hop(adj: DataFrame, x: DataFrame, dims: int, small: bool = False) -> DataFrame:
    """(node, vec): the weighted sum of the neighbours' vectors. One row per edge is joined, not one per edge and dimension; vectors of the nodes with most edges are broadcast, so hubs are not shuffled."""
    side = x.withColumnRenamed("node", "dst")
    if small:  # as measured by vectors_are_small
        j = adj.join(F.broadcast(side), "dst")
    else:
        side = side.join(adj.groupBy("dst").agg(F.count("*").alias("n")), "dst")
        j = frequent_join(adj, side, "dst", "n", frequent=min(FREQUENT, BROADCAST_BYTES // (8 * dims + 200)))
    return j.groupBy(F.col("src").alias("node")).agg(F.array(*[F.sum(F.col("w") * F.col("vec")[i]) for i in range(dims)]).alias("vec"))


def mean_of(parts: list[DataFrame], dims: int, divisor: float) -> DataFrame:
    """(node, vec): the sum of the tables' vectors by node, divided."""
    total = parts[0]
    for x in parts[1:]:
        total = total.unionByName(x)
    return total.groupBy("node").agg(F.array(*[F.sum(F.col("vec")[i]) / divisor for i in range(dims)]).alias("vec"))


def propagated(adj: DataFrame, x0: DataFrame, dims: int, hops: int = 2, small: bool | None = None) -> DataFrame:
    """(node, vec): the mean of x0, A x0, ..., A^hops x0; lineage is cut after each hop."""
    small = vectors_are_small(adj, dims) if small is None else small
    x = cut(x0)
    parts = [x]
    for _ in range(hops):
        x = cut(one_hop(adj, x, dims, small))
        parts.append(x)
    return mean_of(parts, dims, float(hops + 1))


def propagate(adj: DataFrame, x0: DataFrame, dims: int, hops: int = 2) -> DataFrame:
    """(node, dim, x) of propagated(), rounded."""
    return propagated(cut(adj), x0, dims, hops).select("node", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", DIGITS))


def neighbour_mean(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(node, dim, mean): the mean of the neighbours' values."""
    return both_ways(edges).join(x.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "dim").agg(F.round(F.avg("x"), DIGITS).alias("mean"))


def negatives(positives: DataFrame, resumes: DataFrame, per_job: int = 2, draws: int = 8, seed: int = 42) -> DataFrame:
    """(job_id, resume_id, draw): up to per_job resumes per job not linked to it, by seeded draws of dense indexes and an anti-join.

    A job linked to (almost) every resume gets fewer, possibly none.
    """
    idx = int_index(resumes, "resume_id")
    n = idx.count()
    jobs = positives.select("job_id").where("job_id IS NOT NULL").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_job * draws - 1))))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("job_id"), F.lit("|"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = jobs.withColumn("idx", F.pmod(h, F.lit(max(n, 1)))).join(idx, "idx")
    free = drawn.join(positives.select("job_id", "resume_id").distinct(), ["job_id", "resume_id"], "left_anti").groupBy("job_id", "resume_id").agg(F.min("draw").alias("draw"))
    return free.withColumn("n", F.row_number().over(W.partitionBy("job_id").orderBy("draw"))).where(F.col("n") <= per_job).select("job_id", "resume_id", "draw")


def proposals(drawn, least: float, tries: int) -> Column:
    """The numbers 0, 1, .. of a step's proposals, up to the first whose draw is under `least` and so keeps any weight, at most `tries`."""
    return F.sequence(F.lit(0), F.coalesce(*[F.when(drawn(F.lit(t)) < least, t) for t in range(tries - 1)], F.lit(tries - 1)))


def walks(edges: DataFrame, length: int = 10, per_node: int = 20, p: float = 1.0, q: float = 1.0, seed: int = 42, cut_every: int = 4, blocks: int = 1024) -> DataFrame:
    """(start, walk, path): biased random walks over an undirected graph.

    A step proposes a neighbour of the current node by a seeded hash and, with p or q other than 1, keeps one of several
    proposals by weight: 1/p for the previous node, 1 for its neighbours, 1/q else (rejection sampling, TRIES proposals).
    Proposals behind the first one whose draw keeps even the least weight can't be taken, so they are not looked up.
    Neighbours are numbered rows, never gathered: a proposal is a pair (node, number) that joins one row, so a hub's edges
    lie in many tasks. Every node has a neighbour, so no walk ends early.
    """
    both = both_ways(edges)
    # numbers of a node's neighbours without a window over the whole node: blocks by hash are counted and numbered apart
    split = both.withColumn("b", F.pmod(F.xxhash64("dst"), F.lit(blocks)))
    sizes = split.groupBy("src", "b").agg(F.count("*").alias("c"))
    base = sizes.withColumn("from", F.coalesce(F.sum("c").over(W.partitionBy("src").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # at most `blocks` rows a node
    numbered = cut(split.withColumn("k", F.row_number().over(W.partitionBy("src", "b").orderBy("dst")) - 1).join(base.select("src", "b", "from"), ["src", "b"]).select(F.col("src").alias("at"), (F.col("from") + F.col("k")).alias("k"), F.col("dst").alias("to")))
    degree = cut(sizes.groupBy(F.col("src").alias("at")).agg(F.sum("c").alias("d")))
    w = degree.select(F.col("at").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk"), "at", F.array("at").alias("path"), F.lit(None).cast("string").alias("prev"))
    tries = 1 if p == q == 1.0 else TRIES
    top = max(1.0 / p, 1.0, 1.0 / q)
    least = min(1.0 / p, 1.0, 1.0 / q) / top
    known = cut(both.select(F.col("src").alias("prev"), F.col("dst").alias("to"), F.lit(True).alias("near"))) if tries > 1 else None
    degree_, numbered, known = small_side(degree), small_side(numbered), small_side(known) if tries > 1 else None
    for step in range(length - 1):
        draw = lambda *c, step=step: F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "start", "walk", *c), F.lit(1 << 40))
        drawn = lambda t, draw=draw: draw(t, F.lit(1)).cast("double") / float(1 << 40)
        j = w.join(degree_, "at").withColumn("try", F.explode(proposals(drawn, least, tries))).withColumn("k", F.pmod(draw("try"), F.col("d"))).join(numbered, ["at", "k"])
        if tries > 1:
            weight = F.when(F.col("to") == F.col("prev"), 1.0 / p).when(F.col("prev").isNull() | F.col("near"), 1.0).otherwise(1.0 / q)
            kept = drawn("try") < weight / top
            j = j.join(known, ["prev", "to"], "left").withColumn("place", F.when(kept, F.col("try")).otherwise(F.col("try") + tries))
        else:
            j = j.withColumn("place", F.col("try"))
        w = j.groupBy("start", "walk").agg(F.min_by(F.struct("to", "at", "path"), "place").alias("x")).select("start", "walk", F.col("x.to").alias("at"), F.concat("x.path", F.array("x.to")).alias("path"), F.col("x.at").alias("prev"))
        if step % cut_every == cut_every - 1:
            w = cut(w)
    return w.select("start", "walk", "path")


#: Proposals of a biased step: with p = 1 and q = 0.5 one in two is refused at most, so one in 256 steps takes an unweighted proposal.
TRIES = 8


def node2vec(edges: DataFrame, dims: int = 64, length: int = 10, per_node: int = 20, window: int = 5, epochs: int = 10, p: float = 1.0, q: float = 0.5, seed: int = 42) -> DataFrame:
    """(node, vec): skip-gram vectors of the walks, L2-normalised."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    from pairloom.operators.vectors import normalised

    model = Word2Vec(vectorSize=dims, windowSize=window, minCount=1, seed=seed, maxIter=epochs, inputCol="path", outputCol="o", numPartitions=4).fit(cut(walks(edges, length, per_node, p, q, seed)).select("path"))
    return model.getVectors().select(F.col("word").alias("node"), normalised(vector_to_array("vector")).alias("vec"))
