"""The proposals of biased walks."""

import itertools
import random

from pyspark.sql import functions as F

from pairloom.operators import graph


def test_proposals_end_with_the_first_sure_one(spark):
    rng = random.Random(3)
    draws = [tuple(rng.random() for _ in range(8)) for _ in range(400)] + [(0.9,) * 8, (0.1,) * 8]
    df = spark.createDataFrame([(list(d),) for d in draws], "d array<double>")
    got = [r[0] for r in df.select(graph.proposals(lambda t: F.get("d", t), 0.5, 8)).collect()]
    assert got == [list(range(min(8, 1 + len(list(itertools.takewhile(lambda x: x >= 0.5, d)))))) for d in draws]
    assert sum(map(len, got)) < 3 * len(draws)  # all eight of each before


def test_biased_walks_keep_to_the_weights(spark):
    """From a to b, then by weight: back to a with 1/p, to c, which a knows, with 1, to d with 1/q."""
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "src string, dst string")
    w = graph.walks(e, length=3, per_node=4000, p=2.0, q=0.5).where("start = 'a' AND path[1] = 'b'").groupBy(F.col("path")[2]).count().collect()
    n = {r[0]: r[1] for r in w}
    whole = sum(n.values())
    assert abs(n["a"] / whole - 0.5 / 3.5) < 0.03 and abs(n["c"] / whole - 1 / 3.5) < 0.03 and abs(n["d"] / whole - 2 / 3.5) < 0.03
