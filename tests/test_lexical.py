"""The block search of TF-IDF and BM25 against brute force and against the joins of tokens."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import lexical
from pairloom.plans import matching


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def _sparse(rng, n, v):
    """n rows (starts, tokens, weights) over v tokens, some of them empty or alike, low tokens in most rows."""
    rows = [sorted({int(v * rng.random() ** 4) for _ in range(rng.randrange(0, 12))}) for _ in range(n - n // 4)]
    rows += rows[: n // 4]
    return np.cumsum([0, *map(len, rows)]), np.array([t for r in rows for t in r], np.int64), np.array([0.25 + (7 * t) % 5 for r in rows for t in r], float)


@pytest.mark.parametrize("dense, docs, queries, products", [(3, 16, 7, 50), (512, 8192, 1024, 2_000_000), (1, 5, 64, 1)])
def test_best_of_block_is_exact(monkeypatch, dense, docs, queries, products):
    for name, value in (("DENSE", dense), ("DOCS", docs), ("QUERIES", queries), ("PRODUCTS", products)):
        monkeypatch.setattr(lexical, name, value)
    v, rng = 40, random.Random(5)
    q, d = _sparse(rng, 30, v), _sparse(rng, 90, v)
    whole = lambda x: np.array([np.bincount(x[1][a:b], weights=x[2][a:b], minlength=v) for a, b in zip(x[0][:-1], x[0][1:])])
    s = np.round(whole(q) @ whole(d).T, 6)
    want = [(i, int(j), s[i, j]) for i in range(len(s)) for j in sorted(range(s.shape[1]), key=lambda j: (-s[i, j], j))[:10] if s[i, j] > 0]
    assert list(zip(*(x.tolist() for x in lexical.best_of_block(q, d, v, 10)))) == want


def test_lexical_search_takes_every_row_and_every_pair_of_blocks(spark, tmp_path):
    """No query is left out, whatever its row_num, and blocks give the scores of the joins."""
    texts = [("alpha beta", "Beta, gamma?"), ("gamma gamma", "alpha"), ("", "beta beta beta"), ("delta", "???"), ("beta x", "gamma beta"), ("alpha", None)]
    n = range(len(texts))
    spark.createDataFrame([(f"j{i}", texts[i][0], i + 1) for i in n], "job_id string, description string, row_num long").write.parquet(f"{tmp_path}/postings_clean.parquet")
    spark.createDataFrame([(f"r{i}", texts[i][1], i + 1) for i in n], "ID string, Resume_str string, row_num long").write.parquet(f"{tmp_path}/resume_clean.parquet")
    r, j = matching.resumes(spark, str(tmp_path)), matching.jobs(spark, str(tmp_path))
    every = r.withColumn("kind", F.lit("r")).unionByName(j.withColumn("kind", F.lit("j")))
    for direction, q, docs, left, right in (("job", j, r, "job_id", "resume_id"), ("resume", r, j, "resume_id", "job_id")):
        for method, scores in (("tfidf", lexical.tfidf_scores(q, docs, every)), ("bm25", lexical.bm25_scores(q, docs))):
            want = rows(lexical.ranking(scores, q, docs, left, right, method), left, right, "score", "rank", "source")
            assert len(want) == 36 and rows(matching.lexical_top10(spark, str(tmp_path), method, direction), left, right, "score", "rank", "source") == want
    best, pattern = lexical.tfidf_best, lexical.WORDS2
    whole, split = ([lexical.blocks(x.repartition(p, "id"), pattern) for x in (j, r)] for p in (1, 3))
    assert rows(best(*whole), "query", "doc", "score") == rows(best(*split), "query", "doc", "score") != []
    assert best(lexical.blocks(j.limit(0)), whole[1]).count() == 0
