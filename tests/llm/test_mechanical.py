"""Top N, token ids, term weights and mixing against brute force."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import mix, queries, terms, tokens, topn

ODD = ["", None, " ", "a", "  two  spaces \n\n end ", "it's we'll 12,345.6 x_y", "日本語のテキスト。", "ไทย ภาษา", "\x00\x1c\x85 x", "👩🏽‍💻 é", "<|endoftext|> [UNK]", "z" * 30000, " " * 5000 + "q", "\U0001e4d0Ᲊ rare"]


def test_ids_match_the_tokenizer(spark):
    rows = list(enumerate(ODD)) + [(3, "a"), (3, "a"), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("word", F.lit("clash"))
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in tokens.encode(df, "doc_id", "text").collect())
    enc = tokens.encoding()
    assert got == collections.Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows)


def test_ids_match_the_other_library_and_decode(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, sf).collect()}
    assert got == {k: t.encode(v, add_special_tokens=False).ids for k, v in docs.items()}
    assert all(r.same for r in queries.p8_roundtrip(spark, sf).collect())


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_ids_where_the_dictionary_is_too_large_to_broadcast(spark, monkeypatch, frequent):
    monkeypatch.setattr("pairloom.session.is_small", lambda *a, **k: False)
    rows = list(enumerate(ODD)) + [(3, "a"), (None, "null id"), (50, "a b a b " * 50), (51, " the the zqxjkv" * 20 + "end")]
    enc = tokens.encoding()
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in tokens.encode(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", frequent=frequent).collect())
    assert got == collections.Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode(e, "doc_id", "text").count() == 0
    assert tokens.decode(tokens.encode(e, "doc_id", "text"), "doc_id", "ids").count() == 0
    assert topn.top_n(spark.createDataFrame([], "j string, r string, s double"), "j", "r", "s").count() == 0
    r = spark.createDataFrame([], "table_name string, row_num long, text string")
    assert terms.top_terms(r).count() == 0 and terms.top_terms(r, k=3).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    chosen, goal = mix.mixed(docs, spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert chosen.count() == 0 and mix.shares(chosen, goal).first().reached_tokens == 0


@pytest.mark.parametrize("parts,large", [(1, 2), (7, 2), (7, 0)])
def test_top_n_against_brute_force(spark, parts, large, monkeypatch):
    monkeypatch.setattr(topn, "LARGE", large)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(6000):
        j = "hot" if rng.random() < 0.4 else f"j{rng.integers(60)}"
        s = rng.choice([0.0, -0.0, 0.5, 0.5, float(np.round(rng.random(), 2)), float("inf"), float("nan")])
        rows.append((None if rng.random() < 0.01 else j, None if rng.random() < 0.01 else f"r{rng.integers(900)}", None if rng.random() < 0.02 else float(s), "x"))
    best = {}
    for j, r, s, _ in rows:
        if j is not None and r is not None and s is not None and not math.isnan(s):
            best[j, r] = max(best.get((j, r), -math.inf), s)
    want = set()
    for j in {k[0] for k in best}:
        for p, (ns, r) in enumerate(sorted((-s, r) for (a, r), s in best.items() if a == j)[:10], 1):
            want.add((j, r, p))
    df = spark.createDataFrame(rows, "job string, res string, score double, bs string").repartition(parts)
    assert {(x.job, x.res, x.place) for x in topn.top_n(df, "job", "res", "score", 10).collect()} == want


def brute_terms(records):
    toks = [re.findall(r"[^\W]{2,}", (t or "").lower()) for _, _, t in records]
    n = sum(bool(t) for t in toks)
    d = collections.Counter(x for t in toks for x in set(t))
    out = {}
    for (tab, row, _), t in zip(records, toks):
        nb = collections.defaultdict(set)
        for i, x in enumerate(t):
            for y in t[i + 1 : i + terms.WINDOW]:
                if x != y:
                    nb[x].add(y)
                    nb[y].add(x)
        for x, f in collections.Counter(t).items():
            out[tab, row, x] = (f, len(nb[x]), d[x], round(len(nb[x]) * math.log(n / d[x]), 6), round(f * math.log(n / d[x]), 6))
    return out


def test_terms_against_brute_force(spark):
    records = [("t", 1, "a bb cc bb Dd_1"), ("t", 2, "bb"), ("t", 3, None), ("u", 1, "ΣΟΦΌΣ cc éé 12 bb bb bb"), ("u", 2, " . "), ("u", 3, "cc " * 400 + "long")]
    df = spark.createDataFrame(records, "table_name string, row_num long, text string").withColumn("term", F.lit("clash"))
    got = {(r.table_name, r.row_num, r.term): (r.f, r.degree, r.d, r.gow, r.tf) for r in terms.scored(df).collect()}
    assert got == brute_terms(records)


def test_repeated_records_stay_apart(spark):
    df = spark.createDataFrame([("t", 1, "aa bb"), ("t", 1, "aa bb"), ("t", 2, "cc")], "table_name string, row_num long, text string")
    assert sorted((r.row_num, r.term) for r in terms.top_terms(df).collect()) == [(1, "aa"), (1, "aa")]


def test_pivot_keeps_the_size():
    rng = np.random.default_rng(0)
    t, p = rng.integers(1, 500, 300).astype(float), rng.random(300)
    q = mix.pivot(t, p, rng)
    assert abs((t * p).sum() - (t * q).sum()) < 1e-3
    assert ((q > 0) & (q < 1)).sum() <= 1
    runs = np.mean([mix.pivot(t[:6], p[:6], np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(runs - p[:6]).max() < 0.04


@pytest.mark.parametrize("bucket", [7, 20000])
def test_mix_reaches_its_shares(spark, bucket):
    words = ["one", "one two", "one two three four five", "", None]
    rows = [(i, words[i % 5], " A " if i % 3 else "b") for i in range(600)] + [(9001, "x", "other"), (9002, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.3, 1), ("B", 0.6, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen, goal = mix.mixed(docs, targets, bucket=bucket)
    got = {r.source: r for r in mix.shares(chosen, goal).collect()}
    assert abs(got["a"].reached_tokens - got["a"].target_tokens) <= 5
    assert abs(got["b"].reached_tokens - min(got["b"].target_tokens, 2 * got["b"].available_tokens)) <= 5
    assert got["none"].reached_tokens == 0 and max(r.copies for r in chosen.collect()) <= 2
    for parts in (1, 7):
        again, _ = mix.mixed(docs.orderBy(F.rand(parts)).repartition(parts), targets, bucket=bucket)
        assert sorted(chosen.collect()) == sorted(again.collect())
    other, _ = mix.mixed(docs, targets, seed=7, bucket=bucket)
    assert sorted(chosen.collect()) != sorted(other.collect())


def test_mix_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "one two", "a")] * 40 + [(None, "x", "a")] * 3, "doc_id long, text string, source string")
    chosen, goal = mix.mixed(docs, spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int"))
    r = mix.shares(chosen, goal).first()
    assert abs(r.reached_tokens - r.target_tokens) <= 2 and chosen.count() == sum(1 for x in chosen.collect() if x.copies == 1)


@pytest.mark.parametrize("name", ["p6_found", "p6_graph_terms", "p7_found"])
def test_same_rows_by_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("resume_clean", "postings_clean", "job_to_resumes_top10_tfidf"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.execute(queries.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(map(repr, ({c: r[c] for c in sorted(df.columns)} for r in df.collect()))) == sorted(repr({c: v for c, v in sorted(zip(names, r))}) for r in rel.fetchall())
